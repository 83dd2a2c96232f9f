"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest
from codeloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUICK = ("rank_symbols", "unresolved_calls", "file_cycles", "phase_flow", "repo_findings",
         "dedupe_definitions", "parse_script", "self_call_mro", "verify_claims", "failed_claims",
         "vector_topk", "chunk_windows", "ungrounded_words", "scan_filter", "call_stats",
         "json_salvage", "manifest_merge", "alternatives_verdict")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want and got


def test_sql_names_are_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
