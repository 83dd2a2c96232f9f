"""Names in prose that nothing defines: texts are read once and compared with their own code within the row."""

import pytest
from codeloom.functions import text
from codeloom.operators import reviews
from codeloom.plans import catalogue
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
CODE = "\n```py\ndef made_up(x):\n    total_sum = shown_one(x)\nclass Thing_A: pass\n```\n"

CASES = [
    ("`made_up` and `lib.made_up` and `total_sum`" + CODE, {}),
    ("`shown_one`, `lib.shown_one`, `shown_one.other_x`" + CODE,
     {"shown_one": True, "lib.shown_one": True, "shown_one.other_x": False}),
    ("`other_x` `other_x()` ` other_x ` `*other_x`", {"other_x": False}),
    ("`known_a` `x.known_a` `known_a.other_x` `pack.mod_b` `mod_b`", {"known_a.other_x": False, "mod_b": False}),
    ("`short` `four` `\"text_x\"` `a_b = c_d` `.hidden_x` `file_x.py` `()` `été_x`", {"short": False, "été_x": False}),
    ("", {}), (None, {}), ("no names, `open_tick", {}),
    ("`Big_A`\n```\nBig_A\n```\n`Big_A` `Big_B`", {"Big_A": True, "Big_B": False}),
]


def test_names_of_odd_texts(spark):
    sections = spark.createDataFrame([("r", i, c[0]) for i, c in enumerate(CASES)], "repo string, key long, body string")
    known = spark.createDataFrame([("r", "known_a"), ("r", "pack.mod_b"), ("other", "other_x")], "repo string, name string")
    got = {i: {} for i in range(len(CASES))}
    rows = reviews.ungrounded(sections, known).collect()
    for r in rows:
        got[r.key][r.token] = r.in_example
    assert got == {i: c[1] for i, c in enumerate(CASES)}
    assert len(rows) == sum(len(c[1]) for c in CASES)


def test_documents_are_read_once_and_not_shuffled(spark):
    p = catalogue.queries()["ungrounded_words"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert p.count("documents.parquet") == 1 and p.count("regexp_extract_all(regexp_replace") == 1
    assert "hashpartitioning(key" not in p and "hashpartitioning(doc_id" not in p


@pytest.mark.parametrize("mention, token", [
    ("word_a", "word_a"), ("abcd", None), ("abcde", "abcde"), ("A1", "A1"), ("func_a()", "func_a"), ("**kwarg_x", "kwarg_x"), ("_", None),
    ("12", "12"), ("été", "été"), ("x y", None), ("a.b_c", "a.b_c"), ("'q_x'", None), ("()", None)])
def test_token_of_a_mention(spark, mention, token):
    assert spark.createDataFrame([(mention,)], "c string").select(text.mention_token(F.col("c"))).first()[0] == token
