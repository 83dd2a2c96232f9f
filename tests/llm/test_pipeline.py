"""Each stage against a plain version of its decision, on a small made corpus."""

import random
import zlib
from array import array

import pytest

import corpus_pipeline as cp

from . import brute
from .test_near_copies import kept
from .test_packing import FILE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    docs, labels = [], []
    for i in range(160):
        lines = [" ".join(word() for _ in range(r.randrange(5, 25))) for _ in range(r.randrange(1, 5))]
        if i % 8 == 0:
            lines[0] += f" grumbl{r.choice('xyz')} " + word()
        if i % 5 == 0:
            lines.append("  The common FOOTER\t" if i % 2 else "the common footer")
        if i % 7 == 0:
            lines.append(f"call +1 (415) 555-{1000 + i} or u{i}@mail.example.com")
        docs.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, 1, int(i % 8 == 0)))
    docs += [(200 + k, docs[k][1] + " x", "en", "s", 1) for k in range(1, 30, 4)]
    docs += [(300, None, "en", "s", None), (301, "", None, None, 0), (302, " \n ", "en", "s", 1)]
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = corpus()
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_in_turn(spark, folder):
    docs, labels = corpus()
    now = {d[0]: d[1] for d in docs}
    frame = spark.read.parquet(f"{folder}/documents.parquet")

    def step(k):
        nonlocal frame
        out = cp.STAGES[k][1](spark, frame, folder)
        out.write.mode("overwrite").parquet(f"{folder}/out{k}")
        frame = spark.read.parquet(f"{folder}/out{k}")
        return frame.collect()

    rows = step(0)
    assert frame.columns == COLUMNS
    assert {x.doc_id for x in rows} == {i for i, t in now.items() if "grumbl" not in (t or "")}
    now = {i: now[i] for i in (x.doc_id for x in rows)}

    rows = {x.doc_id: x for x in step(1)}
    ids = sorted(now)
    for i, (_, _, left) in zip(ids, brute.line_dedup([now[i] for i in ids], 10), strict=True):
        assert rows[i].text == left and rows[i].n_chars == len(left)
    now = {i: rows[i].text for i in ids}

    rows = step(2)
    assert sorted(x.doc_id for x in rows) == [ids[k] for k in kept([now[i] for i in ids])]
    now = {x.doc_id: x.text for x in rows}

    rows = step(3)
    for x in rows:
        spans, t = brute.base_spans(now[x.doc_id]), now[x.doc_id]
        for s in reversed(spans):
            kind, a, b = s.split(":")
            t = f"{t[:int(a)]}[{kind.upper()}]{t[int(b):]}"
        assert x.text == t and x.n_chars == len(t)
    assert len(rows) == len(now) and any("[PHONE]" in x.text and "[EMAIL]" in x.text for x in rows)
    now = {x.doc_id: x.text for x in rows}

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(FILE)
    got = {}
    for x in sorted(step(4), key=lambda x: x.piece):
        got.setdefault(x.doc_id, array("I")).frombytes(bytes(x.ids))
    assert {i: v.tolist() for i, v in got.items()} == {
        i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in now.items()}


def test_run_equals_its_stages(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, f in cp.STAGES:
        frame = f(spark, frame, folder)
    key = lambda x: (x.doc_id, x.piece, zlib.crc32(x.ids))
    assert sorted(map(key, cp.run(spark, folder).collect())) == sorted(map(key, frame.collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e", "en", "s", 1), (1, "a b c d e", "en", "s", 1), (None, "q r s t u", "en", "s", 1),
            (2, "A b c d e", "en", "s", 1), (None, "v w x y z", "en", "s", 1)]
    out = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((x.doc_id or 0, x.text) for x in out.collect()) == [(0, "q r s t u"), (0, "v w x y z"), (1, "a b c d e")]
