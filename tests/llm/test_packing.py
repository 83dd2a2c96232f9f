import itertools
import random
import zlib
from array import array

import pytest

from codeloom.llm import packing
from codeloom.llm.packing import WordEncoder, pack_documents, plan, sum_of_squares
from codeloom.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/word_bpe_49k.json"


def whole(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(FILE)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


TEXTS = ["Hello, World! It's 3.5 o'clock; they'll we're 'S", "a <|endoftext|> b<|startoftext|>c <|endof", "\x1c a\x1db \x85c\xa0d",
         "Σας ΣΑΣ İstanbul ½²_a_ __!!x é é ﬁ Ⅷ", "¿Qué tal? «Ça va» Ñandú ÀÉÎ", "ab​cd 　 x́y ﻿z", "𝒳 😀😀 日本語 한국어", "", "  ", None, "''s\"'d"]


def test_ids_are_the_tokenizers(monkeypatch):
    r = random.Random(4)
    signs = [chr(c) for c in [*range(1, 256), 0x301, 0x3a3, 0x130, 0x2028, 0x1f600, 0x4e00, 0xfb01, 0x2167, 0x1e9e]]
    texts = TEXTS + ["".join(r.choices(signs + list("aeiou '.,s") * 8, k=60)) for _ in range(400)]
    for size in (packing.CACHE, 3):
        monkeypatch.setattr(packing, "CACHE", size)
        e = WordEncoder(FILE)
        for _ in range(2):
            assert [array("I", e.ids(t or "")).tolist() for t in texts] == whole(texts)


def least_squares(lengths, room):
    """The rule in plain words: try every choice and add up the squares."""
    gaps, out = [], []
    for s in lengths:
        if s >= room:
            gaps.append(0)
            out.append(len(gaps) - 1)
            continue

        def total(k, s=s):
            after = [g - (s if i == k else 0) for i, g in enumerate(gaps)] + ([room - s] if k == len(gaps) else [])
            return sum(after.count(g) ** 2 for g in set(after) if g)
        fits = [(total(k), g, k) for k, g in enumerate(gaps) if g >= s and g] + [(total(len(gaps)), room + 1, len(gaps))]
        best = min(fits)
        k = max(k for t, g, k in fits if (t, g) == best[:2])
        if k == len(gaps):
            gaps.append(room)
        gaps[k] -= s
        out.append(gaps[k])
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares_rule(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 21) for _ in range(60)]
    where = sum_of_squares(lengths, 20)
    gaps = [20 - sum(s for s, b in zip(lengths, where) if b == k) for k in range(max(where) + 1)]
    assert sorted(gaps) == least_squares(lengths, 20)


def test_plan_fills_well():
    r = random.Random(9)
    lengths = [r.randrange(1, 2048) for _ in range(3000)] + [r.randrange(1, 100) for _ in range(3000)]
    bins, offsets, filled = plan(lengths, 2048)
    assert max(filled) <= 2048 and len(filled) <= 1.01 * sum(lengths) / 2048 + 2
    for b in range(len(filled)):
        spans = sorted((offsets[i], lengths[i]) for i in range(len(bins)) if bins[i] == b)
        assert [o for o, _ in spans] == list(itertools.accumulate([0] + [n for _, n in spans]))[:-1]
    assert plan([], 2048) == ([], [], [])


@pytest.mark.parametrize("window", [7, 8192])
def test_documents(spark, monkeypatch, window):
    monkeypatch.setattr(packing, "WINDOW", window)
    r = random.Random(3)
    texts = TEXTS + [" ".join(r.choices(["lorem", "ipsum", "Dolor", "é"], k=r.randrange(400))) for _ in range(60)]
    texts += texts[:3] + ["word " * 20000]
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(texts)]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece string"), FILE, room=256).collect()
    ids = [x + [0] for x in whole(texts)]
    for i, want in enumerate(ids):
        mine = sorted((x for x in out if x.doc_id == (i if i != 5 else None)), key=lambda x: x.piece)
        assert [(x.piece, x.start) for x in mine] == list(enumerate(range(0, len(want), 256)))
        assert list(itertools.chain(*(array("I", x.ids) for x in mine))) == want
        assert all(x.length == len(x.ids) // 4 for x in mine) and zlib.crc32(mine[0].ids) >= 0
    places = {}
    for x in out:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == list(itertools.accumulate([0] + [n for _, n in spans]))[:-1]
        assert sum(n for _, n in spans) <= 256
    assert len(places) <= 1.05 * sum(map(len, ids)) / 256 + 2


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_a_task_leaves_no_cache_behind(monkeypatch):
    import pyarrow as pa

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(packing, "TaskContext", Task)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", "other words"])], ["doc_id", "text"])
    out = list(packing._pack_windows(FILE, 64, 0, keep=False)([batch]))
    assert sum(b.num_rows for b in out) == 2
    assert not packing.encoder(FILE).chunks and not packing.encoder(FILE).words
