import random

import pytest

import corpus_pipeline as cp
from codeloom.llm import near_copies as nc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(s, t):
    def sets(x):
        w = (x or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    a, b = sets(s), sets(t)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(texts):
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if u == high else u for u in up]
    return [i for i in range(len(texts)) if up[i] == i]


def planted(r, words, low, high):
    """A text of random words and a copy with words changed until the similarity lies in [low, high)."""
    while True:
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        copy = list(base)
        while jaccard(" ".join(base), " ".join(copy)) >= high:
            copy[r.randrange(words)] = f"v{r.randrange(5000)}"
        if jaccard(" ".join(base), " ".join(copy)) >= low:
            return " ".join(base), " ".join(copy)


@pytest.mark.parametrize("sample,full", [(16, 4), (1, 0)])
def test_planted_near_copies(spark, monkeypatch, sample, full):
    monkeypatch.setattr(nc, "SAMPLE", sample)
    monkeypatch.setattr(nc, "FULL", full)
    monkeypatch.setattr(nc, "TURNS", 2)
    r, texts = random.Random(5), []
    for low, high in ((0.7, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 0.999)):
        for _ in range(8):
            texts += planted(r, r.randrange(150, 500), low, high)
    chain = [f"c{i}" for i in range(300)]  # each like the next, the ends unlike
    for k in range(12):
        chain[20 * k + 7] = f"d{k}"
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(40))  # common to texts that are not alike
    texts += [passage + " " + " ".join(f"q{r.randrange(9999)}" for _ in range(60)) for _ in range(20)]
    hub = [f"h{i}" for i in range(200)]  # a large group around one text
    for _ in range(40):
        texts.append(" ".join(f"g{r.randrange(9999)}" if r.random() < 0.015 else w for w in hub))
    texts += ["a b c d e f g h i", "A b c d e f g h i", "a b c d e f g h i j", "x y", "X y", "x z", "", None, " \t"]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(x.doc_id for x in cp.drop_near_duplicates(spark, docs, "").collect())
    assert got == kept(texts)


def test_long_text_in_parts(monkeypatch):
    text = (" ".join(f"W{i % 977}" for i in range(5000)) + " \n").encode()
    whole = nc.shingles(text)
    monkeypatch.setattr("codeloom.llm.simhash_dedup._PART", 100)
    assert (nc.shingles(text) == whole).all() and len(whole) == 977


def test_fingerprints_propose_pairs_that_are_compared_in_full(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(400)]
    base, copy, other = " ".join(words), " ".join([*words[:-1], "last"]), " ".join(reversed(words))
    rows = spark.createDataFrame(list(enumerate([base, copy, base + " x", other])), "doc_id long, text string")
    texts = (rows.selectExpr("doc_id", "cast(text as binary) as content")
             .mapInArrow(nc._keys(5), "doc_id bigint, key bigint, n int, content binary"))
    of = {x.key: x.doc_id for x in texts.collect()}
    got = {tuple(sorted((of[x.a], of[x.b]))) for x in nc.proposed_pairs(texts).collect()}
    assert got and got <= {(0, 1), (0, 2), (1, 2)}
    nobody = spark.createDataFrame([], "key bigint, n int, content binary")
    assert nc.proposed_pairs(nobody).collect() == []


def test_parts_of_a_batch_give_the_same_rows(spark, monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([f"a b c d e f g {i}".encode() for i in range(7)])],
                                       ["doc_id", "content"])
    whole = pa.Table.from_batches(nc._keys(5)([batch]))
    monkeypatch.setattr(nc, "PART", 3)
    parts = list(nc._keys(5)([batch]))
    assert [p.num_rows for p in parts] == [3, 3, 1]
    assert pa.Table.from_batches(parts).equals(whole)
