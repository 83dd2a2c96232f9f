import random
from codeloom.operators import reviews, traversal
from pyspark.sql import functions as F


def graph(spark, n, m, seed):
    rng = random.Random(seed)
    e = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
    e = sorted((a, b) for a, b in e if a != b)
    return e, spark.createDataFrame([("r", a, b) for a, b in e], "repo string, caller string, callee string")


def test_reach_against_plain_search(spark):
    e, df = graph(spark, 40, 70, 1)
    seeds = spark.createDataFrame([("r", f"n{i}") for i in range(5)], "repo string, qualname string")
    want = set()
    for s in (f"n{i}" for i in range(5)):
        seen, layer, depth = {s: 0}, [s], 0
        while layer and depth < 4:
            depth += 1
            layer = [b for a, b in e if a in layer and b not in seen]
            seen.update((b, depth) for b in layer)
        want |= {(s, n, d) for n, d in seen.items()}
    got = {(r.start, r.node, r.depth) for r in traversal.reach(seeds, df, 4).collect()}
    assert got == want


def test_diagram_grows_in_order(spark):
    e, df = graph(spark, 30, 60, 2)
    notes = spark.createDataFrame([("r", "n1", 1), ("r", "n2", 2)], "repo string, qualname string, rank int")
    out = lambda q: sorted({b for a, b in e if a == q}) + sorted({a for a, b in e if b == q})
    chosen, ring = ["n1", "n2"], ["n1", "n2"]
    while ring and len(chosen) < 12:
        nxt = []
        for q in ring:
            for x in out(q):
                if x not in chosen and len(chosen) < 12:
                    chosen.append(x)
                    nxt.append(x)
        ring = nxt
    got = [r.qualname for r in traversal.diagram_nodes(notes, df, 12).orderBy("place").collect()]
    assert got == chosen


def test_swaps_survive_any_split(spark):
    rng = random.Random(3)
    rows = [("big" if rng.random() < .6 else f"u{rng.randrange(4)}", i, rng.choice("ab"), 1.0, 2.0)
            for i in range(600)]
    want = {}
    for run, _, model, *_ in rows:
        calls, swaps, last = want.get(run, (0, 0, None))
        want[run] = (calls + 1, swaps + (last not in (None, model)), model)
    df = spark.createDataFrame(rows, "run string, seq long, model string, seconds double, "
                                     "output_tokens double").repartition(7)
    got = {r.run: (r.calls, r.swaps) for r in reviews.call_stats(df).collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    assert reviews.call_stats(df).where(F.col("thrash")).count() == len(want)
