import random
import zlib

import numpy as np

from codeloom.llm import quality
from codeloom.llm.quality import QualityModel, fit_quality, score_quality, terms

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(r.choice("abcdeést") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 120))]
        good = i % 3 != 0
        text = " ".join(w).capitalize() + "." if good else r.choice(
            [" ".join(x.upper() + "!!" for x in w), " ".join(x for x in w[:9] for _ in range(9)), " | ".join(w)])
        docs.append((i, text, 5))
        labels.append((i, int(good), 0))
    return docs, labels


def test_learns_and_scores_every_row(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(900, None, 5), (901, "", 5), (902, "x", 5), (None, "a b c", 5), (3, docs[3][1], 5)],
                              "doc_id long, text string, quality_score int").selectExpr("*", "'q' as quality", "1 as content")
    model = fit_quality(d, spark.createDataFrame(labels + [(None, 1, 1), (7000, 0, 0), (3, None, 0)], LABELS))
    out = score_quality(d, model).collect()
    assert len(out) == len(docs) + 5 and out[0].quality == "q" and all(0 <= x.quality_score <= 1 for x in out)
    want = {i: y for i, y, _ in labels}
    right = sum((x.quality_score >= 0.5) == (want[x.doc_id] == 1) for x in out if x.doc_id in want)
    assert right >= 0.97 * (len(docs) + 1)
    a, b = (x.quality_score for x in out if x.doc_id == 3)
    assert a == b


def test_votes_are_those_of_all_pairs():
    r = np.random.default_rng(1)
    x = np.abs(r.normal(size=(40, quality.TERMS))).astype(np.float32)
    axes = r.normal(size=(quality.TERMS, quality.DIMENSIONS)).astype(np.float32)
    m = QualityModel(x.mean(axis=0), axes, np.zeros((0, 1)), (r.random(40) > 0.4).astype(np.float32), 0.5)
    m.vectors = m.latent(x)
    q = np.abs(r.normal(size=(9, quality.TERMS))).astype(np.float32)
    for row, got in zip(m.latent(q), m.score(q), strict=True):
        near = sorted(((float(row @ v), y) for v, y in zip(m.vectors, m.labels, strict=True)), reverse=True)[:15]
        w = [max(s, 0) ** 4 for s, _ in near]
        assert abs(got - (sum(a * y for a, (_, y) in zip(w, near, strict=True)) + 5e-4) / (sum(w) + 1e-3)) < 1e-4


def test_terms_of_whole_long_texts(monkeypatch):
    text = ("Some words, 12 of them!\n" * 400).encode()
    whole = terms(text)
    monkeypatch.setattr(quality, "_PART", 1000)
    assert np.allclose(terms(text), whole, atol=1e-6) and not np.allclose(terms(text + b"Z!" * 900), whole, atol=1e-3)
    assert not terms(b"").any() and terms(b"a").any()


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    model = fit_quality(d, spark.createDataFrame([], LABELS))
    assert score_quality(d, model).first().quality_score == 0.5
    assert score_quality(d.limit(0), model).count() == 0
    seen = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1)
    one = fit_quality(spark.createDataFrame([(seen, "abc")], d.schema), spark.createDataFrame([(seen, 1, 0)], LABELS))
    assert score_quality(d, one).first().quality_score > 0.5
