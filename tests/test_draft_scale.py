"""A draft asks only for what its few notes and claims need; what grows with the input is not sent through the driver."""

import pytest
from codeloom.operators import callgraph, claims, generation, ranking, reviews
from codeloom.operators.generation import FactCompleter
from codeloom.plans import document, graph_queries

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_edges_are_merged_not_sent(spark):
    p = plan(graph_queries._edges(spark, DIR))
    assert "SortMergeJoin [p_partkey" in p
    assert "Join" not in plan(callgraph.self_owners(graph_queries._symbols(spark, DIR)))


def test_edges_of_other_definitions_are_left_unsorted(spark, garden):
    notes = ranking.rank_symbols(garden.symbols, garden.edges, garden.exports, 2)
    for df in (notes, generation.describe_symbols(notes, garden.symbols, garden.edges, FactCompleter())):
        p = plan(df)
        assert "LeftSemi" in p.split("WindowGroupLimit", 1)[1]
    few = {r.qualname: r.calls for r in notes.collect()}
    all_ = {r.qualname: r.names for r in callgraph.callees(garden.edges, 10).collect()}
    assert few == {q: all_.get(q, []) for q in few} and any(few.values())


def test_symbols_are_scored_once_for_a_map(garden, monkeypatch):
    scored, real = [], ranking.scored_symbols
    monkeypatch.setattr(ranking, "scored_symbols", lambda *a: scored.append(a) or real(*a))
    st = document.State(files=garden.files, analysis=garden)
    document.stage_map(st, FactCompleter(), 3)
    assert len(scored) == 1
    assert {r.qualname for r in st.entry.collect()} == {
        r.qualname for r in ranking.entry_points(real(garden.symbols, garden.edges, garden.exports)).collect()}


SAID = [("calls", "grow", "water", "`grow` calls `water`"), ("calls", "`Plant.grow()`", "garden.year", "grow calls year"),
        ("parameter", "Plant", "pot", "Plant takes pot"), ("parameter", "Plant", "soil", "Plant takes soil"),
        ("parameter", "garden.Plant", "*height", "Plant takes height"), ("location", "year", "garden.py:9", "year is at 9"),
        ("location", "spring", "season", "spring is in season"), ("location", "ripen", "Tomato:3", "ripen in Tomato"),
        ("location", "ripen", "wrong.py", "ripen is in wrong.py"), ("calls", "turbo", "water", "turbo calls water"),
        ("calls", "year", "water", "year calls water"), (None, "rest", None, None), ("calls", "season", None, "season")]


@pytest.mark.parametrize("said", [SAID, SAID[2:3], SAID[6:7], SAID[:1]])
def test_claims_are_judged_alike_on_the_symbols_they_name(spark, garden, said):
    found = spark.createDataFrame([("plot", f"s#{i}", "s", i, *c) for i, c in enumerate(said)],
                                  "repo string, claim_id string, section_key string, ord int, type string, subject string, "
                                  "object string, quote string")
    near = claims.named_symbols(found, garden.symbols)
    rows = lambda s: sorted(map(repr, claims.judge_claims(found, s, garden.edges).collect()))
    assert rows(near) == rows(garden.symbols)
    assert near.count() == near.select("repo", "qualname").distinct().count() < garden.symbols.count()


def test_only_mentioned_names_are_gathered(spark, garden):
    sections = spark.createDataFrame([("plot", "k", "`water` and `garden.Plant.grow()`, `leaves`, `turbo_x`\n```\n`year`\n```")],
                                     "repo string, key string, body string")
    asked = reviews.mentioned(sections)
    assert {r.name for r in asked.collect()} == {"water", "garden.Plant.grow", "grow", "leaves", "turbo_x"}
    whole = {r.name for r in reviews.known_names(garden.symbols, garden.attributes).collect()}
    got = [r.name for r in reviews.known_names(garden.symbols, garden.attributes, asked).collect()]
    assert sorted(got) == sorted({r.name for r in asked.collect()} & whole)
