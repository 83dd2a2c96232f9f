"""Which rows each filter of a chain removes, in every order of the filters.

Every filter is a table of the ids it fails. What a prefix of an order leaves, takes, finds taken already and
loses of the labelled rows comes from left-anti and left-semi joins of those tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import BLANKS, text_or_empty

#: Orders are listed in full, so their number is the factorial of this.
MOST_FILTERS = 8
_KEY = ["doc_id", "digest"]


@dataclass(frozen=True)
class Failing:
    """rows: doc_id, digest, part, n (equal rows are one with a count); ids: per filter a table of doc_id, digest."""

    rows: DataFrame
    ids: dict[str, DataFrame]


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: few words, repeated words, capitals, signs."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    w = words(text)
    return {"A": F.size(w) < 50, "B": 100 * F.size(F.array_distinct(w)) < 65 * F.size(w),
            "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failing_ids(docs: DataFrame, conditions: dict[str, Column], repeated: str | None = None,
                doc_id: str = "doc_id", text: str = "text", part: str = "source") -> Failing:
    """Judge whole texts once and store one id table per filter.

    conditions: columns over a text named `text`. repeated: name of one more filter, failed by a text that some
    smaller doc_id has too. A null text or part counts as empty, a failed condition that is null as passed. Texts
    are told apart by SHA-256. Rows that repeat a doc_id with other texts are judged each by itself; equal rows
    are kept as one with a count. A null doc_id is no smaller one and has no smaller one. Only the three named
    columns are read, so others cannot clash.
    """
    slim = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), text_or_empty(docs[f"`{text}`"]).alias("text"),
                       F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"))
    marks = {f: F.coalesce(c, F.lit(False)).alias(f"fails_{f}") for f, c in conditions.items()}
    judged = as_table(
        slim.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *marks.values())
        .groupBy("doc_id", "digest", "part", *[f"fails_{f}" for f in conditions]).agg(F.count("*").alias("n")))
    ids = {f: as_table(judged.where(f"fails_{f}").select(*_KEY).distinct()) for f in conditions}
    if repeated:
        # All but the smallest of a text. Joined on both columns, so that a text with many copies is not one key.
        named = judged.where("doc_id is not null").select(*_KEY)
        ids[repeated] = as_table(named.distinct().join(
            named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), _KEY, "left_anti"))
    return Failing(judged.select("doc_id", "digest", "part", "n"), ids)


def _within(rows: DataFrame, ids: DataFrame, how: str, *more: Column) -> DataFrame:
    on = [rows["doc_id"].eqNullSafe(ids["doc_id"]), rows["digest"] == ids["digest"], *more]
    return rows.join(ids, on, how)


def _flagged(rows: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """rows with a flag: among the doc_ids or not."""
    return (rows.join(ids, "doc_id", "left_semi").withColumn(name, F.lit(True))
            .unionByName(rows.join(ids, "doc_id", "left_anti").withColumn(name, F.lit(False))))


def prefix_counts(failing: Failing, good: DataFrame, toxic: DataFrame) -> DataFrame:
    """of, before, part, n, good, toxic: rows that are in `of` and in no filter of the set `before` (a bit each).

    `of` is a filter (what it takes after that set) or null (rows with any failure that survive the set).
    A row is multiplied over the sets after the shuffle, bit by bit, and leaves where an anti-join finds it; all
    joins have one key, so the rows are dealt out once. Rows that fail nothing are not among them.
    """
    rows = _flagged(_flagged(failing.rows, "good", good), "toxic", toxic)
    rows = as_table(rows)
    every = None
    for ids in failing.ids.values():
        every = ids if every is None else every.union(ids)
    alive = _within(rows, every.distinct(), "left_semi").withColumn("of", F.lit(None).cast("string"))
    for f, ids in failing.ids.items():
        alive = alive.unionByName(_within(rows, ids, "left_semi").withColumn("of", F.lit(f)))
    # Dealt out on the names the joins use, so that every later join finds it done.
    alive = alive.withColumn("before", F.lit(0))
    for bit, (f, ids) in enumerate(failing.ids.items()):
        both = F.array(F.col("before"), F.col("before") + F.lit(1 << bit))
        alive = alive.withColumn("before", F.explode(F.when(F.col("of").eqNullSafe(f), F.array("before")).otherwise(both)))
        alive = _within(alive, ids, "left_anti", F.col("before").bitwiseAND(1 << bit) != 0)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return alive.groupBy("of", "before", "part").agg(
        F.sum("n").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def audit(failing: Failing, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per part, order of all filters and step: what the step's filter does after those before it.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (all long
    counts of rows, zeros included). labels: doc_id, quality, toxic; a document is good where any of its labels
    has quality 1, toxic where any has toxic 1; nulls label nothing. An empty table gives no rows.
    """
    names = list(failing.ids)
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders to list; {MOST_FILTERS} is the most")
    spark, k = labels.sparkSession, len(names)
    chosen = lambda c: labels.where(F.col(c) == 1).select(
        labels[f"`{doc_id}`"].cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    found = as_table(prefix_counts(failing, chosen("quality"), chosen("toxic")))
    # What is left of each part after each set of filters: all its rows but those that failed and did not survive.
    alive = found.where("of is null").select("part", F.col("before").alias("after"), F.col("n").alias("alive"))
    totals = (failing.rows.groupBy("part").agg(F.sum("n").alias("total"))
              .join(alive.where("after = 0").select("part", F.col("alive").alias("failed")), "part", "left"))
    steps = [(f, bit, s) for bit, f in enumerate(names) for s in range(1 << k) if not s >> bit & 1]
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("of"), F.lit(s).alias("before"), F.lit(s | 1 << bit).alias("after"),
                                         F.lit(factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1"))).alias("orders"))
                                for f, bit, s in steps]))
    grid = totals.select("*", every.alias("x")).select("part", "total", "failed", "x.*")
    taken = found.where("of is not null")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    whole = (1 << k) - 1
    bits = F.create_map(*[F.lit(v) for bit, f in enumerate(names) for v in (f, whole ^ 1 << bit)])
    per = (grid.join(taken, ["part", "of", "before"], "left").join(alive, ["part", "after"], "left")
           .groupBy("part", "of").agg(
               # At most 2^(k-1) sets of one filter: a bounded list.
               F.collect_list(F.struct("before", zero(F.col("n")).alias("removed"), zero(F.col("good")).alias("good_lost"),
                                       zero(F.col("toxic")).alias("toxic_lost"),
                                       (F.col("total") - zero(F.col("failed")) + zero(F.col("alive"))).alias("kept"))).alias("sets"),
               F.sum(F.when(F.col("before") == 0, zero(F.col("n"))).otherwise(0)).alias("fails"),
               F.sum(F.when(F.col("before") == bits[F.col("of")], zero(F.col("n"))).otherwise(0)).alias("unique_fails"),
               F.sum(zero(F.col("n")) * F.col("orders")).alias("shapley"))
           .select("part", "of", "fails", "unique_fails", "shapley", F.explode("sets").alias("s"))
           .select("part", "of", "fails", "unique_fails", "shapley", "s.*"))
    place = {f: 1 << bit for bit, f in enumerate(names)}
    orders = spark.createDataFrame(
        [("".join(o), i + 1, f, sum(place[g] for g in o[:i])) for o in permutations(names) for i, f in enumerate(o)],
        "filter_order string, step int, of string, before int")
    return per.join(orders, ["of", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley")
