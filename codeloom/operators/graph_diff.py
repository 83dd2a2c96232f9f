"""What changed between two snapshots of a corpus: definitions added, removed, renamed, moved or calling others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import as_table

#: Rings of neighbours that a fingerprint takes in.
RINGS = 2


def _fingerprints(open_defs: DataFrame, matched: DataFrame, edges: DataFrame, rings: int) -> DataFrame:
    """(repo, qualname, label) of open definitions: body, then ring by ring the labels of callees and callers.

    Matched definitions keep the label of their match, so both snapshots describe open ones by the same names.
    Labels of neighbours are added up as numbers, so a hub is a partial sum and no list.
    """
    either = edges.select("repo", F.col("caller").alias("qualname"), F.col("callee").alias("near"), F.lit(0).alias("side")) \
        .unionByName(edges.select("repo", F.col("callee").alias("qualname"), F.col("caller").alias("near"), F.lit(1).alias("side")))
    either = either.join(open_defs, ["repo", "qualname"], "left_semi")
    fixed = matched.select("repo", F.col("qualname").alias("near"), F.xxhash64(F.lit("="), "as").alias("label"))
    now = open_defs.select("repo", "qualname", F.xxhash64("body").alias("label"))
    for _ in range(rings):
        labels = fixed.unionByName(now.withColumnRenamed("qualname", "near"))
        around = either.join(labels, ["repo", "near"]).groupBy("repo", "qualname").agg(
            F.sum(F.xxhash64("label", "side").cast("decimal(20,0)")).alias("around"), F.count("*").alias("n"))
        now = as_table(now.join(around, ["repo", "qualname"], "left").select(
            "repo", "qualname", F.xxhash64("label", "around", "n").alias("label")))
    return now


def match_definitions(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame, rings: int = RINGS) -> DataFrame:
    """(repo, old, new): definitions of two snapshots that are the same one, at most one for each.

    Equal names match first. Then open definitions match whose fingerprint, of their body and the rings of
    neighbours around them, occurs once in each snapshot. What matched names its neighbours in the next turn;
    turns end when nothing more matches. Definitions are repo, qualname, name, file, body (anything that stays
    the same when a definition is only renamed or moved).
    """
    olds, news = (as_table(d.select("repo", "qualname", F.col("body").cast("string").alias("body"))) for d in (old, new))
    parts = [as_table(olds.join(news, ["repo", "qualname"], "left_semi").select(
        "repo", F.col("qualname").alias("old"), F.col("qualname").alias("new")))]
    while True:
        found = reduce(DataFrame.unionByName, parts)
        sides = []
        for defs, edges, side in ((olds, old_edges, "old"), (news, new_edges, "new")):
            taken = found.select("repo", F.col(side).alias("qualname"), F.col("new").alias("as"))
            left = as_table(defs.join(taken, ["repo", "qualname"], "left_anti"))
            labels = _fingerprints(left, taken, edges, rings)
            sides.append(labels.groupBy("repo", "label").agg(F.min("qualname").alias(side), F.count("*").alias("n"))
                         .where("n = 1").drop("n"))
        more = as_table(sides[0].join(sides[1], ["repo", "label"]).select("repo", "old", "new"))
        if more.isEmpty():
            return found
        parts.append(more)


def graph_diff(old: DataFrame, new: DataFrame, old_edges: DataFrame, new_edges: DataFrame, rings: int = RINGS) -> DataFrame:
    """(repo, change, old, new, gained, lost): one row for each change of a definition.

    change: added, removed, renamed (another last name), moved (the last name in another place) or rewired (calls
    gained and lost, callees compared as what they match; calls to what was removed count as lost). One definition
    can be both moved and rewired. Null on the side where it is not; gained and lost are 0 but for rewired.
    """
    matched = as_table(match_definitions(old, new, old_edges, new_edges, rings))
    o = old.select("repo", F.col("qualname").alias("old"), F.col("name").alias("old_name"), F.col("file").alias("old_file"))
    n = new.select("repo", F.col("qualname").alias("new"), F.col("name").alias("new_name"), F.col("file").alias("new_file"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    removed = o.join(matched, ["repo", "old"], "left_anti").select("repo", F.lit("removed").alias("change"), "old", none.alias("new"))
    added = n.join(matched, ["repo", "new"], "left_anti").select("repo", F.lit("added").alias("change"), none.alias("old"), "new")
    placed = matched.join(o, ["repo", "old"]).join(n, ["repo", "new"]).select(
        "repo", F.when(F.col("old_name") != F.col("new_name"), "renamed")
        .when((F.col("old") != F.col("new")) | ~F.col("old_file").eqNullSafe(F.col("new_file")), "moved").alias("change"),
        "old", "new").where("change is not null")
    names = removed.unionByName(added).unionByName(placed).withColumns({"gained": zero, "lost": zero})
    # Both edge tables under the new names; a callee without a match keeps its old name, which no new one has.
    end = lambda c: matched.select("repo", F.col("old").alias(c), F.col("new").alias(f"new_{c}"))
    was = old_edges.select("repo", "caller", "callee").distinct().join(end("caller"), ["repo", "caller"]) \
        .join(end("callee"), ["repo", "callee"], "left").select(
            "repo", F.col("new_caller").alias("new"), F.coalesce("new_callee", F.concat(F.lit("-"), "callee")).alias("callee"), F.lit(-1).alias("d"))
    now = new_edges.select("repo", F.col("caller").alias("new"), "callee").distinct() \
        .join(matched.select("repo", "new"), ["repo", "new"], "left_semi").withColumn("d", F.lit(1))
    count = lambda d: F.sum(F.when(F.col("d") == d, 1).otherwise(0)).cast("long")
    moved = was.unionByName(now).groupBy("repo", "new", "callee").agg(F.sum("d").alias("d")).where("d <> 0") \
        .groupBy("repo", "new").agg(count(1).alias("gained"), count(-1).alias("lost"))
    rewired = moved.join(matched, ["repo", "new"]).select("repo", F.lit("rewired").alias("change"), "old", "new", "gained", "lost")
    return names.unionByName(rewired)
