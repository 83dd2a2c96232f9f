import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from codeloom.llm.filter_audit import audit, failing_ids, text_conditions

DOCS = "doc_id long, text string, source string, part string, digest int, n int"
LABELS = "doc_id long, quality int, toxic int"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """Failing filters of each row, judged in plain Python."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = t.replace("\x1c", "x").split()
        f = set()
        if len(w) < 50:
            f.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            f.add("C")
        if any(c in "#$%&*|" for c in t):
            f.add("D")
        if i is not None and i > first[t]:
            f.add("E")
        out.append(f)
    return out


def plain(rows, labels, names="ABCDE"):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    judged, out = fails(rows), {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f & set(names)) for (i, _, p), f in zip(rows, judged) if (p or "") == part]
        for order in permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                all_f = [x for x in mine if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(all_f) - len(gone), sum(x[1] == {f} for x in all_f),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for f in names:
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(total)
    return out


def corpus():
    r = random.Random(5)
    texts = []
    for i in range(60):
        w = [r.choice("ab cd ef Gh IJ kl".split()) if i % 3 else "".join(r.choice("abcdefghi") for _ in range(6))
             for _ in range(r.choice([3, 49, 50, 80]))]
        texts.append(r.choice([" ", "\t", "\n\x0b"]).join(w) + r.choice(["", "", " 5%", " A|B"]))
    rows = [(i, r.choice(texts), r.choice(["hot", "hot", "b", None, ""])) for i in range(160)]
    rows += [(500, None, "b"), (501, "", "b"), (None, texts[0], "b"), (None, texts[0], None), (3, rows[3][1], rows[3][2]),
             (3, rows[3][1], rows[3][2]), (4, "another text under a known id", "only"), (502, "word " * 40000, "long"),
             (503, "É È ÀÀ", "b"), (504, "a b \x1c c", "b"), (505, " \n\t ", "b")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 170, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 0), (502, 1, 1)]
    return rows, labels


def run(spark, rows, labels, **kw):
    d = spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], DOCS)
    out = audit(failing_ids(d, kw.pop("conditions", text_conditions(F.col("text"))), **kw),
                spark.createDataFrame(labels, LABELS))
    got = out.collect()
    found = {(x.part, x.filter_order, x.step): [x[m] for m in MEASURES] for x in got}
    assert len(found) == len(got)
    return out, found


def test_every_order_and_part(spark):
    rows, labels = corpus()
    out, found = run(spark, rows, labels, repeated="E")
    assert found == plain(rows, labels)
    types = dict(out.dtypes)
    assert types["step"] == "int" and {types[m] for m in MEASURES} == {"bigint"}


def test_other_filters_and_a_null_condition(spark):
    rows, labels = corpus()
    two = {k: c for k, c in text_conditions(F.col("text")).items() if k in "AD"}
    two["D"] = F.when(F.length("text") > 0, two["D"])
    _, found = run(spark, rows, labels, conditions=two)
    assert found == plain(rows, labels, "AD")


def test_empty_tables_and_nothing_failing(spark):
    assert run(spark, [], [], repeated="E")[1] == {}
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "a")]
    _, found = run(spark, rows, [], repeated="E")
    assert found == plain(rows, []) and all(v == [1, 0, 0, 0, 0, 0, 0] for v in found.values())


def test_too_many_filters(spark):
    d = spark.createDataFrame([(1, "a", "s", "x", 1, 2)], DOCS)
    with pytest.raises(ValueError, match="orders"):
        audit(failing_ids(d, {str(i): F.lit(False) for i in range(9)}), spark.createDataFrame([], LABELS))
