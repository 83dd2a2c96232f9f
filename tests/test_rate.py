"""The rate of resolved calls by one lookup of names: the counts of all resolved calls, without a table of them."""

from codeloom import session
from codeloom.operators import callgraph
from codeloom.plans import catalogue, graph_queries


def tables(spark, folder):
    """Parts with equal names, a part without a name and one that is there twice, orders and lines without keys."""
    part = [(1, "red bolt", "Brand#1", "SMALL", 3), (2, "red bolt", "Brand#1", "LARGE", 4), (4, "red nut", "Brand#2", "SMALL", 5),
            (7, "red nut", "Brand#2", "ECONOMY", 6), (10, "red cap", "Brand#3", "STANDARD", 7), (13, None, "Brand#3", "SMALL", 8),
            (16, "red pin", "Brand#1", "SMALL", 9), (16, "red pin", "Brand#1", "SMALL", 9), (19, "red rod", "Brand#1", "SMALL", 50)]
    orders = [(k, c) for k, c in enumerate([0, 1, 3, 4, 9, 10, 12, None, 18, 40])]
    lines = [(o, p, n, q, "RAN"[(o + p) % 3]) for n, q in ((1, 5.0), (2, 50.0), (3, None)) for o in range(10) for p in (1, 4, 7, 10, 13, 16, 19)]
    lines += [(None, 1, 1, 5.0, "R"), (1, None, 1, 5.0, "A"), (3, 1, 1, 5.0, None)]
    for name, rows, schema in (
            ("part", part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
            ("orders", orders, "o_orderkey long, o_custkey long"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_rate_is_that_of_all_resolved_calls(spark, tmp_path):
    at = tables(spark, tmp_path)
    resolved = graph_queries._resolved(spark, at)
    want = callgraph.resolution_rate(callgraph.call_edges(resolved), callgraph.unresolved_calls(resolved)).collect()
    got = callgraph.resolution_rate(*graph_queries._rated(spark, at)).collect()
    assert got == want and got[0].edges > 0 and got[0].unresolved > 0
    outcomes = {r.outcome for r in resolved.select("outcome").distinct().collect()}
    assert outcomes == {"edge", "recursion", "ambiguous", "missing"}


def test_no_table_of_calls_is_written(spark, tmp_path):
    at, before = tables(spark, tmp_path), len(session._TABLES)
    catalogue.queries()["resolve_rate"](spark, at)
    assert [spark.read.parquet(t).columns for t in session._TABLES[before:]] == [["repo", "p_partkey", "callee", "n"]]
