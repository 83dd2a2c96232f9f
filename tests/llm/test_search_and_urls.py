import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import topk
from codeloom.llm.topk import exact_top_k
from codeloom.llm.url_rules import judge_urls, rules_from


def best(rows, every, k):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in rows
          if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for i, q in ok:
        if i % every == 0:
            s = sorted((-int(np.dot(q, c)), j) for j, c in ok if j != i and len(c) == len(q))
            out += [(i, r, j, -v) for r, (v, j) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bins,cell,block", [(2048, 32768, 8192), (2, 40, 3), (7, 1000, 1)])
def test_top_k_matches_brute_force(spark, monkeypatch, bins, cell, block):
    for name, v in (("BINS", bins), ("CELL", cell), ("BLOCK", block)):
        monkeypatch.setattr(topk, name, v)
    r = random.Random(1)
    rows = [(i, [r.uniform(-.5, .5) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.25, 0.25, 0.0, 0.0, 0.0, 0.5]) for i in range(150, 260)]  # one vector many times
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5),
             (None, [0.1] * 6), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (500, [])]
    df = spark.createDataFrame([(i, v, 7, "a") for i, v in rows], "vec_id long, embedding array<float>, score int, dim string")
    with_floats = [(x.vec_id, x.embedding) for x in df.collect()]
    out = exact_top_k(df, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, out.collect())) == best(with_floats, 20, 10)


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1e30])], "vec_id long, embedding array<double>")
    got = exact_top_k(df, F.col("vec_id") == 0, k=5).collect()
    assert [(x["rank"], x.vec_id) for x in got] == [(1, 2), (2, 1)]
    assert exact_top_k(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert exact_top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("bins", [2, 2048])
def test_top_k_scores_up_to_the_end_of_a_long(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "BINS", bins)
    rows = [(i, [2e5 + 5e3 * i] * 60) for i in range(24)] + [(24 + i, [-2e5 - 4e3 * i] * 60) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 20 == 0, k=30).collect()))
    assert got == best(rows, 20, 30) and max(abs(x[3]) for x in got) > 1 << 61
    far = spark.createDataFrame([(0, [1e12] * 4), (1, [1e12] * 4), (2, [1e13] * 4), (3, [-1e13] * 4)],
                                "vec_id long, embedding array<double>")
    assert [tuple(x) for x in exact_top_k(far, F.col("vec_id") == 0, k=3).orderBy("rank").collect()] == [
        (0, 1, 1, 2 ** 63 - 1), (0, 2, 2, 2 ** 63 - 1), (0, 3, 3, 1 - 2 ** 63)]


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end], rest[end:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[3], max(fit)[2]) if fit else (None, "allow")))


def test_urls_match_brute_force(spark):
    r = random.Random(2)
    names = ["com", "org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "org.com", "é.org", "a..org", "org."]
    paths = ["", "/", "/e", "/es/", "/es/1", "/x/y/z", "//", "/é"]
    rules = sorted({(r.choice(names), r.choice(paths), r.choice(["allow", "block"])) for _ in range(40)})
    urls = [f"http://{r.choice(names)}{r.choice(paths)}{r.choice(['', '?q=/es/', '#f', '?a://b/c', '1/2'])}" for _ in range(600)]
    urls += [None, "", "example.org/es/", "://", "HTTP://EXAMPLE.ORG/ES/", "http://ÉX.org/es/", "x://y\nz/é", "http://org:80/es/",
             "a://b://c/d", "http://example.org?x/es/"] + ["http://example.org/es/1"] * 300
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    found = judge_urls(pages, spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string"))
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in found.collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == verdict(u, rules), u


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = rules_from(spark, ["allow org/", "block example.org/es/"])
    assert judge_urls(none, rules).count() == 0
    one = judge_urls(spark.createDataFrame([(None, "http://org/")], "page_id long, url string"), rules.limit(0)).first()
    assert (one.page_id, one.rule, one.verdict) == (None, None, "allow")
