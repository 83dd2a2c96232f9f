import random
from array import array

import numpy as np
import pytest

from codeloom.llm import pieces
from codeloom.llm.pieces import Pieces, decode_documents, encode_documents
from codeloom.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = ["Hello  world\n\tfoo €𐍈 é", " leading", "trailing  ", "   ", "\x00\x01 a", "日本語 😀", "aaaaaaaaaaaaaaaa" * 30, "x",
         "<s> </s> <0x0A> <unk>", "The quick brown fox, isn't it?", "é" * 100, "\n", "a b"]


def some(n=150):
    r = random.Random(1)
    signs = list("abcdefghijklmnop   etaoin,.\n\t") + ["é", "ß", "語", "😀", "\x07"]
    return TEXTS + ["".join(r.choices(signs, k=r.randrange(1, 120))) for _ in range(n)]


def test_without_dropout_the_same_as_the_library():
    import sentencepiece
    p, mine = sentencepiece.SentencePieceProcessor(model_file=FILE), Pieces(FILE, 0.0, 0)
    for t in some():
        assert array("I", mine.encode(t, 1)).tolist() == p.encode(t), repr(t)


def agenda(v, marked, doc):
    """All candidates of the whole text on one agenda; each that comes off it is skipped by its own hash or merged."""
    key, gone, spans = v.key(doc), set(), [(i, i + 1) for i in range(len(marked))]
    while True:
        found = [(v.rank[marked[a:c]], a, b, c, k) for k, ((a, b), (_, c)) in enumerate(zip(spans, spans[1:]))
                 if (a, b, c) not in gone and marked[a:c] in v.rank]
        if not found:
            return [marked[a:b] for a, b in spans]
        _, a, b, c, k = min(found)
        if v.below and v._skips_one(key, a, b, c):
            gone.add((a, b, c))
        else:
            spans[k:k + 2] = [(a, c)]


def spelt(v, found):
    return [i for p in found for i in ([v.id[v.rank[p]]] if p in v.rank else
                                       [v.byte[b] for b in p.replace(pieces._LITERAL, "▁").encode()])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_round_trip_and_agendas_agree(dropout):
    v = Pieces(FILE, dropout, 7)
    texts = [*some(60), "▁ ▁▁x ▁", "", "\ue000", "word " * 40, "antidisestablishmentarianism " * 6]
    got = v.encode_all(texts, list(range(len(texts))))
    for doc, (t, ids) in enumerate(zip(texts, got, strict=True)):
        assert v.decode(ids) == t
        marked = "▁" + t.replace("▁", pieces._LITERAL).replace(" ", "▁")
        assert array("I", ids).tolist() == (spelt(v, agenda(v, marked, doc)) if t else []), repr(t)
        assert v.encode(t, doc) == ids


def test_share_of_skipped_candidates():
    v = Pieces(FILE, 0.1, 7)
    key, a = np.uint64(v.key(1)), np.arange(100000, dtype=np.uint64)
    got = v.skips(key, a, a + np.uint64(1), a + np.uint64(2))
    assert abs(got.sum() - 10000) < 400
    assert got[:500].tolist() == [v._skips_one(v.key(1), k, k + 1, k + 2) for k in range(500)]
    assert v.skips(key, a[5:6], a[6:7], a[7:1007]).sum() < 200  # each end has a key of its own


def test_rows_as_the_heap(monkeypatch):
    t = "The agendas, and their neighbours, are followed; é語 " * 30
    rows = Pieces(FILE, 0.3, 3).encode(t, 9)
    monkeypatch.setattr(pieces, "WIDTHS", (2,))
    assert Pieces(FILE, 0.3, 3).encode(t, 9) == rows


def test_blocks_change_nothing(monkeypatch):
    texts = some(40)
    whole = Pieces(FILE, 0.2, 3).encode_all(texts, list(range(len(texts))))
    monkeypatch.setattr(pieces, "BLOCK", 7)
    assert Pieces(FILE, 0.2, 3).encode_all(texts, list(range(len(texts)))) == whole


def test_dropout_varies_and_repeats():
    v, again, other = Pieces(FILE, 0.2, 1), Pieces(FILE, 0.2, 1), Pieces(FILE, 0.2, 2)
    t = "merges are skipped by keyed hashes so segmentations differ between documents " * 20
    assert v.encode(t, 5) == again.encode(t, 5) != other.encode(t, 5)
    assert v.encode(t, 5) != v.encode(t, 6)
    base, full = len(Pieces(FILE, 0.0, 0).encode(t, 0)), len(Pieces(FILE, 1.0, 0).encode(t, 0))
    assert base < len(v.encode(t, 5)) < full == 4 * (len(t) + 1)


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(some(20))] + [(None, "no id", "x"), (7, None, "x"), (8, "", "x"), (8, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode_documents(encode_documents(df, FILE), FILE).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((g.doc_id, g.text) for g in got), key=key) == sorted(((i, t or "") for i, t, _ in rows), key=key)
    assert all(g.n_pieces == len(g.ids) // 4 for g in got)
    assert encode_documents(df.limit(0), FILE).count() == 0


def test_long_chunk():
    v = Pieces(FILE, 0.1, 1)
    t = "ab" * 40000
    assert v.decode(v.encode(t, 1)) == t
