import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.spelling import _runs, _tile, common_prefix, matrix, near_words, respelt, roots, spelling_variants, word_counts

from .brute import low


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain(n, ratio=2):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def vocabulary(r, size=500):
    out = set()
    while len(out) < size:
        w = "".join(r.choice("abé") for _ in range(r.randrange(5, 9)))
        out |= {w, w + r.choice("abß")}
    return {w: r.choice([3, 3, 4, 6, 7, 12, 50, 101]) for w in sorted(out)} | {"x" * 400: 9, "x" * 401: 3, "日本語日本語": 5, "日本語日本": 11}


def found(df):
    rows = df.collect()
    out = {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("tiles", [{}, {"tile_rows": 7}, {"tile_points": 40}])
def test_same_as_all_pairs(spark, tiles):
    n = vocabulary(random.Random(4))
    words = spark.createDataFrame([(w, c, "k", 1) for w, c in n.items()], "word string, n long, form string, block int")
    assert found(spelling_variants(words, **tiles)) == plain(n)


def test_counts_and_whole_query(spark):
    r = random.Random(8)
    base = ["garden", "gardens", "gartens", "Éclair", "éclair", "naïve", "flower", "flowers", "house", "HOUSE"]
    rows = [(i, " ".join(r.choice(base) + r.choice(["", ",", "5", "\n"]) for _ in range(30))) for i in range(400)]
    rows += [(None, "garden garden"), (900, None), (901, ""), (7, rows[7][1]), (902, "tiny wordy " * 50000), (903, "q" * 30000)]
    d = spark.createDataFrame([(i, t, 1, "w", "f") for i, t in rows], "doc_id long, text string, n int, word string, form string")
    want = plain_counts(rows)
    assert {x.word: x.n for x in word_counts(d).collect()} == want and len(want) > 12
    assert found(spelling_variants(word_counts(d))) == plain(want)


def test_runs_of_long_texts_are_not_cut():
    text = "añb" * 5 + " " + "Ab" * 40 + "×÷ÿ" + " w" * 9
    assert sum((Counter(dict([x])) for part in (1, 3, 10, 1000) for x in _runs(text, part)), Counter()) == Counter(
        {low(w): 4 * c for w, c in Counter(re.findall("[A-Za-zÀ-ÿ]+", text)).items()})


def test_chains_of_any_length(spark):
    for size in (1, 2, 9, 40):
        steps = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(size)], "word string, form string")
        assert {(x.word, x.root) for x in roots(steps).collect()} == {(f"{i:03}", f"{size:03}") for i in range(size)}


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert near_words(spark.createDataFrame([("alone", 5)], "word string, n long")).collect() == []
    assert word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abÿĀ", min_size=3, max_size=4), min_size=2, max_size=9, unique=True))
def test_a_tile_by_all_pairs(words):
    for front in (True, False):
        rows = [(0, 4, front, 0, 0, 0, w, 1) for w in words]
        got = {w: c for w, c, _, _ in _tile(rows)}
        want = Counter()
        for a in words:
            for b in words:
                if one_edit(a, b) and max(len(a), len(b)) == 4 and \
                        (next((i for i in range(3) if a[i] != b[i]), 3) >= 1) == front:
                    want[a] += 1
        assert got == dict(want)


def test_matrices():
    a, b = matrix(["abc", "abé"], np.uint8), matrix(["abc", "xbc"], np.uint8)
    assert common_prefix(a, b, 3).tolist() == [[3, 0], [2, 0]]
    assert respelt(1, "word") in {"word", "ord", "wrd", "wod", "wor"}
