import random

import numpy as np
import pytest
import xxhash

from codeloom.llm import simhash_dedup as sh
from codeloom.llm.components import connected_components
from codeloom.llm.simhash_dedup import as_hex, near_links, simhash_components, trie_self_join


def plain(text):
    w = [x for x in __import__("re").findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))]
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, ids, budget=4):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i] = up[up[i]]
        return i
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(values)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(values))]


def near_copies(r, n, flips=7):
    out = [r.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        v = r.choice(out)
        for _ in range(r.randrange(flips)):
            v ^= 1 << r.randrange(64)
        out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("leaf,frontier", [(1, 50), (16, 1 << 18), (10000, 7)])
def test_trie_walk(monkeypatch, leaf, frontier):
    monkeypatch.setattr(sh, "LEAF", leaf)
    monkeypatch.setattr(sh, "FRONTIER", frontier)
    r = random.Random(1)
    v = near_copies(r, 300)
    label = trie_self_join(np.zeros(len(v), int), np.array(v, np.uint64), 64, 4)
    assert label.tolist() == components(v, list(range(len(v))))


def test_trie_walk_joins_dense_group_without_all_pairs():
    v = np.arange(1 << 14, dtype=np.uint64)  # every 14-bit value
    assert not trie_self_join(np.zeros(len(v), int), v, 64, 4).any()


@pytest.mark.parametrize("blocks,chunk", [(None, 1 << 14), (6, 1 << 14), (5, 3)])
def test_links_over_tasks(spark, monkeypatch, blocks, chunk):
    monkeypatch.setattr(sh, "CHUNK", chunk)
    v = near_copies(random.Random(2), 400)
    signed = [x - (1 << 64) if x >> 63 else x for x in v]
    links = near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, blocks)
    root = {x.node: x.root for x in connected_components(links).collect()}
    got = [root.get(x, x) for x in signed]
    want = components(v, signed)
    assert got == want


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_documents(spark):
    r = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "é", "x"] + [f"w{i}" for i in range(200)]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(300))) for _ in range(25)]
    texts = base + [b + " tail" for b in base] + base[:5] + [None, "", " \t\x0b", "one", "a b c", "a b c d"]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)]
    out = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp string, a int"))
    got = {x.doc_id: x for x in out.select("doc_id", as_hex(out.fp).alias("h"), "component_id").collect()}
    values = [plain(t) for t in texts]
    assert [got[i].h for i in range(len(texts))] == [f"{v:016x}" for v in values]
    assert [got[i].component_id for i in range(len(texts))] == components(values, list(range(len(texts))))


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"W{i % 977}" for i in range(5000)) + " \n"
    monkeypatch.setattr(sh, "_PART", 100)
    assert sh.fingerprint(text.encode()) % (1 << 64) == plain(text)


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (4, "a"), (None, "b b"), (4, "a")], "doc_id long, text string")
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in simhash_components(df).collect()) == [
        (-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert simhash_components(df.limit(0)).count() == 0
