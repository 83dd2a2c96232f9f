"""Edges of the catalog by one lookup of names, without tables of call sites."""

import pytest
from codeloom import session
from codeloom.operators import callgraph
from codeloom.plans import catalogue, corpus, graph_queries

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_edges_as_from_resolved_calls(spark):
    rows = lambda df: sorted(map(repr, df.select("repo", "caller", "callee", "ord").collect()))
    got = rows(graph_queries._edges(spark, DIR))
    assert got == rows(callgraph.call_edges(graph_queries._resolved(spark, DIR))) and got


def test_edges_write_no_table_of_sites(spark):
    before = list(session._TABLES)
    p = plan(catalogue.queries()["fan_in_out"](spark, DIR))
    assert session._TABLES == before
    assert "l_returnflag" not in p and "l_linenumber" not in p


def test_kept_edges_hold_no_places(spark):
    assert graph_queries._narrow_edges(spark, DIR).columns == ["repo", "caller", "callee"]


def symbols(spark, *rows):
    return spark.createDataFrame([("r", *r) for r in rows], "repo string, qualname string, name string, kind string, "
                                                            "owner_class string, bases array<string>")


@pytest.mark.parametrize("defs, owners", [
    ([("m.p1.f", "f", "method", "m.A", [])], set()),
    ([("m.A.f", "f", "method", "m.A", [])], {"m.A"}),
    ([("m.x", "x", "method", "m.A", []), ("m.A", "A", "class", None, ["B"]), ("m.B", "B", "class", None, None)], {"m.A"}),
    ([("m.x", "x", "method", "m.A", []), ("m.A", "A", "class", None, [])], set())])
def test_owners_that_may_answer(spark, defs, owners):
    assert {r.owner_class for r in callgraph.self_owners(symbols(spark, *defs)).collect()} == owners


def test_calls_on_self_take_the_whole_way(spark, monkeypatch):
    """Where a class may answer a call on self, every call is resolved as before."""
    sym = corpus.catalog_symbols(spark, DIR)
    asked = []
    monkeypatch.setattr(callgraph, "self_owners", lambda s: sym.limit(1))
    monkeypatch.setattr(graph_queries, "_resolved", lambda *a: asked.append(a) or spark.createDataFrame(
        [("r", "a", "b", "edge", 1)], "repo string, caller string, callee string, outcome string, call_ord int"))
    assert [(r.caller, r.callee) for r in graph_queries._edges(spark, DIR).collect()] == [("a", "b")] and asked
