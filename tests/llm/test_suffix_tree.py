import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm.suffix_tree import score_texts

END = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def plain(rows, learn, share, keep, weight):
    """(n_tokens, n_known, base, score) for each row, by dictionaries of word tuples."""
    train = [tokens(t) for t, x in zip(rows, learn) if x]
    n = Counter(g for w in train for k in range(3) for i in range(k, len(w)) for g in [tuple(w[i - k:i + 1])])
    total, v = sum(len(w) for w in train), sum(len(g) == 1 for g in n)
    least = max(1.0, share * total)
    cand = {g for g, c in n.items() if len(g) == 1 and c >= least}
    cand |= {g for g, c in n.items() if len(g) == 2 and c >= least and g[:1] in cand}

    def p(context, w, less=0):
        if not context:
            return (n[w,] + 1) / (total + v + 1)
        return (n[*context, w] - less + weight * p(context[1:], w)) / (n[context] - less + weight)

    gain = defaultdict(float)
    for w in train:
        for i in range(len(w)):
            for k in (1, 2):
                c = tuple(w[i - k:i]) if i >= k else None
                if c in cand and (k == 1 or c[1:] in cand):
                    gain[c] += math.log(p(c, w[i], 1) / p(c[1:], w[i]))
    kept = {c for c, g in gain.items() if g >= keep * n[c]}
    kept |= {c[1:] for c in kept if len(c) == 2}
    out = []
    for t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for i, x in enumerate(w):
            base += math.log10(p((), x))
            state = next((c for k in (2, 1) if i >= k and (c := tuple(w[i - k:i])) in kept), ())
            score += math.log10(p(state, x))
        out.append((len(w), sum(n[x,] > 0 for x in w), base, score))
    return out, kept


def corpus(n=250):
    r = random.Random(2)
    follow = {w: r.choices("sun moon star rain snow wind".split(), k=2) for w in "sun moon star rain snow wind".split()}
    pair = {"sun moon": "storm", "rain rain": "flood"}
    rows = []
    for i in range(n):
        w = ["sun"]
        for _ in range(r.randrange(60)):
            w.append(pair.get(" ".join(w[-2:])) if r.random() < 0.5 and " ".join(w[-2:]) in pair
                     else r.choice(follow.get(w[-1], ["sun"])) if r.random() < 0.8 else f"w{r.randrange(400)}")
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w).title() if i % 2 else " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "Sun"), (903, "É é"), (None, "sun moon"), (5, rows[5][1]), (5, rows[5][1])]


def away(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


COLUMNS = "doc_id long, text string, tokens int, row string, score double"


@pytest.mark.parametrize("sizes", [{}, {"chunk": 7, "bucket": 64}, {"chunk": 300, "bucket": 500}])
def test_same_as_plain_counts(spark, sizes):
    rows = corpus() + [(904, " ".join(f"sun moon w{i % 50}" for i in range(700)))]
    d = spark.createDataFrame([(i, t, 1, "r", 0.5) for i, t in rows], COLUMNS).repartition(3)
    out = score_texts(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, min_share=2e-3, keep=0.02, **sizes)
    learn = [i is not None and not away(i) for i, _ in rows]
    want, kept = plain([t for _, t in rows], learn, 2e-3, 0.02, 8.0)
    got = out.scores.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[3], 6))
    assert [key((x.doc_id, x.n_tokens, x.n_known, x.base_score)) + (x.learned,) for x in sorted(
        got, key=lambda x: key((x.doc_id, x.n_tokens, x.n_known, x.base_score)))] == [
        key((i, a, b, s)) + (y,) for i, a, b, s, y in sorted(
            ((i, a, b, s, y) for (i, _), (a, b, s, _), y in zip(rows, want, learn)), key=lambda x: key(x[:4]))]
    scores = {(i, round(b, 6)): s for (i, _), (_, _, b, s) in zip(rows, want)}
    for x in got:
        assert x.score == pytest.approx(scores[x.doc_id, round(x.base_score, 6)], rel=1e-9)
    found = Counter((x.depth, x.kept) for x in out.contexts.collect())
    assert found[1, True] == sum(len(c) == 1 for c in kept) and found[2, True] == sum(len(c) == 2 for c in kept) > 0
    assert {x.train_tokens for x in got} == {sum(w for (w, *_), y in zip(want, learn) if y)}
    held = [x for x in got if not x.learned and x.n_tokens > 20]
    assert sum(x.score for x in held) > 0.9 * sum(x.base_score for x in held)


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(x.n_tokens, x.n_known, x.base_score, x.score, x.train_tokens) for x in score_texts(
        d, F.lit(None).cast("boolean")).scores.orderBy("doc_id").collect()] == [(3, 0, 0.0, 0.0, 0), (1, 0, 0.0, 0.0, 0)]
    assert score_texts(d.where("false"), F.lit(True)).scores.collect() == []
