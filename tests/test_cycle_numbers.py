"""Cycles are searched with numbers for names, and told by the first name."""

from codeloom import session
from codeloom.operators import cycles


def test_rounds_hold_numbers_and_components_names(spark):
    calls = [("r", *e) for e in ("zb", "bz", "by", "ya", "ay", "cc", "pz", "aq")] + [("s", "b", "z"), ("s", "z", "k"), ("s", "k", "z")]
    df = spark.createDataFrame(calls, "repo string, caller string, callee string")
    before = len(session._TABLES)
    got = {tuple(r) for r in cycles.cycles(df).select("repo", "qualname", "component").collect()}
    assert got == {("r", "z", "b"), ("r", "b", "b"), ("r", "y", "a"), ("r", "a", "a"), ("s", "z", "k"), ("s", "k", "k")}
    kept = [dict(spark.read.parquet(p).dtypes) for p in session._TABLES[before:]]
    assert [t for t in kept if "a" in t] and all(t.get(c, "bigint") == "bigint" for t in kept for c in ("a", "b", "node", "label"))
