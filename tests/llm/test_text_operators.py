import random

import pytest
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup as grace
from codeloom.llm.exact_dedup import exact_dedup
from codeloom.llm.line_dedup import dedup_lines
from codeloom.llm.pii import as_text, find_pii, redact

from . import brute

SCHEMA = "doc_id long, text string, n_lines string, t1 int, pii string, `odd name` int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in enumerate(texts)], SCHEMA)


def test_lines_match_brute_force(spark):
    r = random.Random(5)
    common = ["Footer text", "  footer TEXT\t", "Éa", "éa", "", "x"]
    texts = ["\n".join(r.choice(common + [f"own {r.randrange(40)}"]) for _ in range(r.randrange(1, 9)))
             for _ in range(120)] + [None, "", "\n\n", "Footer text", "x\n" * 3000]
    texts += texts[:5]
    got = dedup_lines(frame(spark, texts), min_docs=12).orderBy("doc_id").collect()
    assert [(g.n_lines, g.n_dropped, g.kept_text) for g in got] == brute.line_dedup(texts, 12)
    assert got[0]["odd name"] == 2 and got[0].t1 == 1 and got[0].pii == "y"


def test_lines_of_empty_table(spark):
    assert dedup_lines(frame(spark, [])).count() == 0


def test_exact_match_brute_force(spark):
    r = random.Random(6)
    texts = [r.choice(["Aa", "aA", "É", "é", "", None, "long " * 5000, "a\nb"]) for _ in range(80)] + ["one"]
    rows = {x.doc_id: x for x in exact_dedup(frame(spark, texts)).collect()}
    norm = [brute.low(t or "") for t in texts]
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        x = rows[i]
        assert (x.keep_id, x.group_size, x.kept, bytes(x.digest).hex()) == (max(same), len(same), i == max(same),
                                                                           brute.sha(n))


def test_exact_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (3, "B"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup(df).collect()
    assert len(rows) == 5
    assert {(x.doc_id, x.keep_id, x.group_size, x.kept) for x in rows} == {
        (None, None, 2, True), (3, 3, 3, True), (None, 3, 3, False)}
    assert exact_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("room", [100, 2000, 1 << 30])
def test_spill_recursion_and_equal_digests(room):
    r = random.Random(7)
    content = [bytes([r.randrange(3)]) * r.randrange(200) for _ in range(400)]
    digest = lambda c: bytes(31) + bytes([len(c) % 4])  # noqa: E731  many contents with one digest
    out = list(grace._classes(iter([(digest(c), c, [i], -1) for i, c in enumerate(content)]), room=room))
    assert sorted(i for _, _, ids in out for i in ids) == list(range(400))
    seen = {}
    for d, o, ids in out:
        for i in ids:
            seen.setdefault((d, o), set()).add(content[i])
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len(set(content))


PII = ["mail a.b@c.de.fg, x@y and A@b..c d@e.f_x@g.h.i", "ip 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 9.9.9",
       "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111", "+1 (415) 555-2671, +49(0)30--12345678. +1+2",
       "é한\U0001f600 call +1 (415) 555-2671\n 4012888888881881 ", "", None, "9" * 6000, "a" * 6000 + "@",
       "1.2.3.4 4111111111111111 +4111111111111111 q@1.2.3.4", "+1 4111111111111111 1.1.1.1-2",
       "-".join("1" * 4 for _ in range(4000)), "b." * 20000 + "@" + "c." * 20000 + "d", "(" * 5000 + "+1" + "." * 5000]


def test_pii_base_spans_match_brute_force(spark):
    r = random.Random(8)
    alphabet = "0123456789+-. ()@ab.é" + "4111"
    texts = PII + ["".join(r.choice(alphabet) for _ in range(r.randrange(400))) for _ in range(400)]
    df = find_pii(frame(spark, texts))
    got = df.select("doc_id", as_text(F.filter("pii", lambda s: s["base"])).alias("s"), "odd name", "n_lines").collect()
    assert len(got) == len(texts) and got[0].n_lines == "x"
    for g in got:
        assert g.s == ",".join(brute.base_spans(texts[g.doc_id])), texts[g.doc_id]


def test_pii_added_kinds_and_redaction(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB83 WEST 1234 5698 7654 32", "my ssn is 123-45-6789", "123-45-6789",
             "a@b.cd 1.2.3.4@x.yz", None, "plain"]
    df = find_pii(frame(spark, texts))
    kinds = [[s.kind for s in x.pii] for x in df.orderBy("doc_id").collect()]
    assert kinds == [["iban"], [], ["national_id"], [], ["email", "email", "ip"], [], []]
    masked = [x.text for x in redact(df).orderBy("doc_id").collect()]
    assert masked == ["IBAN [IBAN] ok", texts[1], "my ssn is [NATIONAL_ID]", texts[3], "[EMAIL] [EMAIL]", None, "plain"]


def test_pii_account_number_before_other_words(spark):
    n, spaced, gb = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    texts = {f"IBAN {n} BIC: COBADEFF": [n], f"{spaced} BIC COBADEFF": [spaced], f"to {n} I sent": [n],
             f"{spaced} Isent": [spaced], f"{n}, then": [n], f"BE12 CDEF {spaced} {gb} 100 EUR": [spaced, gb],
             f"é {n} {n} X": [n, n], f"{n}I": [], f"{n[:-1]}1 BIC": [], f"x{n} BIC": [], n: [n],
             "ZZ22370400440532013000 AND MORE": ["ZZ22370400440532013000"]}
    rows = find_pii(frame(spark, list(texts))).orderBy("doc_id").collect()
    for x, (text, want) in zip(rows, texts.items(), strict=True):
        assert [text[s.start:s.end] for s in x.pii if s.kind == "iban"] == want, text
    assert {s.score for s in rows[0].pii} == {1.0} and {s.score for s in rows[2].pii} == {0.9}


def test_pii_many_matches(spark):
    text = " ".join(f"u{i}@h.io" for i in range(3000))
    got = find_pii(frame(spark, [text])).select(as_text(F.col("pii")).alias("s")).first().s
    assert got == ",".join(brute.base_spans(text))
    assert find_pii(frame(spark, [])).count() == 0
