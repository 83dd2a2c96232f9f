import random
from collections import deque

import numpy as np

from codeloom.operators.centrality import churn, hot_spots, page_rank
from codeloom.operators.cycles import blast_radius, cycles, dependents
from codeloom.operators.graph_diff import graph_diff

EDGES = "repo string, caller string, callee string"


def graph(seed, nodes=40, arcs=55):
    r = random.Random(seed)
    out = {(f"n{r.randrange(nodes):02}", f"n{r.randrange(nodes):02}") for _ in range(arcs)}
    return sorted(out | {(f"n{i:02}", f"n{(i + 1) % 5:02}") for i in range(5)})


def plain(arcs):
    """Component of each node and, for each component, the least steps from every component that leads to it."""
    names = sorted({x for e in arcs for x in e})
    to = {n: {n} for n in names}
    for _ in names:
        for a, b in arcs:
            to[a] |= to[b]
    part = {n: min(m for m in names if m in to[n] and n in to[m]) for n in names}
    up = {}
    for a, b in arcs:
        if part[a] != part[b]:
            up.setdefault(part[b], set()).add(part[a])
    depth = {}
    for c in set(part.values()):
        depth[c], todo = {c: 0}, deque([c])
        while todo:
            x = todo.popleft()
            for y in up.get(x, ()):
                if y not in depth[c]:
                    depth[c][y] = depth[c][x] + 1
                    todo.append(y)
    return part, depth


def test_cycles_and_dependents(spark):
    by_repo = {"a": graph(1), "b": graph(4, 30, 60), "line": [("n00", "n01"), ("n01", "n02"), ("n02", "n02")]}
    edges = spark.createDataFrame([(r, *e) for r, arcs in by_repo.items() for e in arcs], EDGES)
    want_cycles, want, radius = set(), set(), set()
    seeds = [(r, f"n{i:02}") for r in by_repo for i in (0, 2, 7, 11)] + [("line", "alone"), ("a", "n00")]
    for r, arcs in by_repo.items():
        part, depth = plain(arcs)
        sizes = [list(part.values()).count(c) for c in part.values()]
        want_cycles |= {(r, n, c) for (n, c), k in zip(part.items(), sizes) if k > 1}
        for q in {q for x, q in seeds if x == r}:
            mine = {(r, q, n, depth[part[q]][c]) for n, c in part.items() if q in part and n != q and c in depth[part[q]]}
            want |= mine
            radius.add((r, q, len(mine), max((x[3] for x in mine), default=0), sum(x[3] == 0 for x in mine)))
    assert {tuple(x) for x in cycles(edges).collect()} == want_cycles and want_cycles
    s = spark.createDataFrame(seeds, "repo string, qualname string")
    assert sorted(map(tuple, dependents(s, edges).collect())) == sorted(want)
    assert sorted(map(tuple, blast_radius(s, edges).collect())) == sorted(radius)
    assert cycles(edges.where("false")).collect() == []


def test_page_rank_is_the_stationary_distribution(spark):
    arcs = graph(9)
    names = sorted({x for e in arcs for x in e} | {"alone"})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b in arcs:
        if a != b:
            m[at[b], at[a]] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / len(names))  # what calls nothing passes on to all
    x = np.full(len(names), 1 / len(names))
    for _ in range(500):
        x = 0.85 * m @ x + 0.15 / len(names)
    symbols = spark.createDataFrame([("a", n) for n in names] + [("b", "only")], "repo string, qualname string")
    edges = spark.createDataFrame([("a", *e) for e in arcs + arcs[:3]] + [("a", "n00", "unknown")], EDGES)
    got = {(r.repo, r.qualname): r.centrality for r in page_rank(symbols, edges).collect()}
    assert got.pop(("b", "only")) == 1 and len(got) == len(names)
    assert np.allclose([got["a", n] for n in names], x * len(names), atol=1e-8)


def test_churn_counts_changes_and_gaps(spark):
    rows = [("a", "same", v, "1") for v in range(4)] + [("a", "often", v, str(v)) for v in range(4)]
    rows += [("a", "gap", 0, "1"), ("a", "gap", 3, "1"), ("a", "gone", 0, "1"), ("a", "late", 3, "x"), ("a", "null", 2, None), ("a", "null", 3, None)]
    changes = churn(spark.createDataFrame(rows, "repo string, qualname string, version int, fingerprint string"))
    assert {x.qualname: x.changes for x in changes.collect()} == {"same": 0, "often": 3, "gap": 2, "gone": 1, "late": 0, "null": 0}
    rank = spark.createDataFrame([("a", "often", 2.0), ("a", "never", 1.5)], "repo string, qualname string, centrality double")
    assert {x.qualname: (x.changes, x.heat) for x in hot_spots(rank, changes).collect()} == {"often": (3, 6.0), "never": (0, 0.0)}


def test_what_changed_between_two_snapshots(spark):
    def defs(rows):
        return spark.createDataFrame([("a", q, q.rsplit(".", 1)[1], f, b) for q, f, b in rows],
                                     "repo string, qualname string, name string, file string, body string")
    old = [("m.top", "m.py", "t"), ("m.mid", "m.py", "x"), ("m.twin1", "m.py", "w"), ("m.twin2", "m.py", "w"),
           ("m.leaf", "m.py", "x"), ("m.gone", "m.py", "g"), ("m.stay", "m.py", "s"), ("m.deep", "m.py", "x")]
    new = [("m.top", "m.py", "t"), ("m.middle", "m.py", "x"), ("m.twin3", "m.py", "w"), ("m.twin4", "m.py", "w"),
           ("lib.leaf", "lib.py", "x"), ("m.stay", "n.py", "s"), ("m.fresh", "m.py", "f"), ("m.depth", "m.py", "x")]
    e_old = [("m.top", "m.mid"), ("m.mid", "m.leaf"), ("m.top", "m.gone"), ("m.stay", "m.top"), ("m.leaf", "m.deep")]
    e_new = [("m.top", "m.middle"), ("m.middle", "lib.leaf"), ("m.stay", "m.top"), ("m.stay", "m.fresh"), ("lib.leaf", "m.depth")]
    frame = lambda e: spark.createDataFrame([("a", *x) for x in e], EDGES)
    got = {tuple(x)[1:] for x in graph_diff(defs(old), defs(new), frame(e_old), frame(e_new), rings=1).collect()}
    assert got == {("renamed", "m.mid", "m.middle", 0, 0), ("moved", "m.leaf", "lib.leaf", 0, 0), ("moved", "m.stay", "m.stay", 0, 0),
                   ("renamed", "m.deep", "m.depth", 0, 0), ("removed", "m.gone", None, 0, 0), ("added", None, "m.fresh", 0, 0),
                   ("removed", "m.twin1", None, 0, 0), ("removed", "m.twin2", None, 0, 0), ("added", None, "m.twin3", 0, 0),
                   ("added", None, "m.twin4", 0, 0), ("rewired", "m.top", "m.top", 0, 1), ("rewired", "m.stay", "m.stay", 1, 0)}
    assert graph_diff(defs(old), defs(old), frame(e_old), frame(e_old)).collect() == []
