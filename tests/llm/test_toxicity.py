import random

import pytest

from codeloom.llm.toxicity import KINDS, Reader, ToxicityModel, compose, fit_toxicity, score_toxicity, scope

LABELS = "doc_id long, quality int, toxic int"


def kinds(text, stems=()):
    return [k for k, _, _ in Reader(ToxicityModel(stems)).matches(text)]


@pytest.mark.parametrize("text,want", [
    ("You are an idiot.", ["aimed_insult_asserted"]),
    ("An idiot, you!", ["aimed_insult_asserted"]),
    ("What a moron", ["insult_asserted"]),
    ("He is not an idiot. Fine", ["aimed_insult_negated"]),
    ("She said that he is a moron", ["aimed_insult_reported"]),
    ("I will kill you", ["threat_asserted"]),
    ("I will not kill you", ["threat_negated"]),
    ("He said I will kill you", ["threat_reported"]),
    ("They kill time", []), ("you. kill", []), ("", []), ("idiotic", []),
])
def test_clauses(text, want):
    assert kinds(text) == want


def test_learned_stems_and_offsets():
    r = Reader(ToxicityModel((("blargh", False), ("zonk", True))))
    text = "İx fine. du blarghling; zonky zonk"
    found = r.matches(text)
    assert [k for k, _, _ in found] == ["aimed_insult_asserted", "insult_asserted"]
    assert text[found[0][1]:found[0][2]].strip() == "du blarghling"


def test_composition_equals_running_in_turn():
    r, alphabet = random.Random(1), set("ITN.")
    a, b = scope("N", "I", "-", 2, alphabet), scope("T", "I", "!", 3, alphabet | {"I-"})
    both = compose(a, b, alphabet)
    for _ in range(200):
        s = [r.choice("ITN.") for _ in range(12)]
        assert both.run(s) == b.run(a.run(s))


def corpus(n=400):
    r = random.Random(2)
    words = [f"wort{i:03d}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(40)] = "grumbl" + r.choice("aeiou") + r.choice("xyz")
        docs.append((i, " ".join(w), "keep"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_stems_and_holds_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(1000, None, "keep"), (1001, "", "keep"), (None, "grumblox", "keep")],
                              "doc_id long, text string, toxicity string")
    wide = d.selectExpr("*", "1 as score", "2 as matches")
    model = fit_toxicity(wide, spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], LABELS))
    assert model.stems[0][0].startswith("grumbl") and len(model.weights) == len(KINDS) + 1
    out = score_toxicity(wide, model).collect()
    assert len(out) == len(docs) + 3 and out[0].score == 1 and out[0].matches == 2
    for x in out:
        assert (x.toxicity.score >= 0.7) == ("grumbl" in (x.text or "")), x
        assert 0 <= x.toxicity.score <= 1


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "You are an idiot")], "doc_id long, text string")
    model = fit_toxicity(d, spark.createDataFrame([], LABELS))
    assert model == ToxicityModel()
    assert score_toxicity(d, model).first().toxicity.score > 0.7
    assert score_toxicity(d.limit(0), model).count() == 0


def test_a_stem_always_after_one_word_is_learned(spark):
    r = random.Random(6)
    rows = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(30)) + (" you blorgface" if i % 4 == 0 else "")) for i in range(600)]
    rows += [(1000 + k, rows[4][1].upper() + " ") for k in range(50)]
    labels = [(i, 1, int(i % 4 == 0)) for i, _ in rows[:600]] + [(1000 + k, 1, 1) for k in range(50)]
    model = fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS))
    assert [s for s, _ in model.stems] == ["blorgface"] or model.stems[0][0].startswith("blor")
