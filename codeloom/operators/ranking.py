"""Which definitions matter: score, role, ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..session import cut_lineage
from .callgraph import callees, of_nodes, with_fan


def score(in_exports: Column, owner_exported: Column) -> Column:
    """Importance from graph shape alone. Every term is a multiple of 0.02."""
    name = F.col("name")
    public = ~name.startswith("_")

    def bonus(cond: Column, points: float) -> Column:
        return F.when(cond, points).otherwise(0.0)

    total = (3.0 * F.least(F.col("fan_in"), F.lit(5)) + 1.5 * F.least(F.col("fan_out"), F.lit(6))
             + bonus(F.coalesce(F.col("docstring"), F.lit("")) != "", 2.0)
             + bonus(F.col("kind") == "class", 1.5)
             + bonus(in_exports, 9.0)
             + bonus(owner_exported & public, 5.0)
             - bonus(name.startswith("_") & ~name.startswith("__"), 4.0)
             - bonus(name.startswith("__") & (name != "__init__"), 1.0)
             + F.least(F.col("line_count") / 25.0, F.lit(2.0)))
    return F.round(total, 2)


def role() -> Column:
    fan_in, fan_out = F.col("fan_in"), F.col("fan_out")
    return (F.when(F.col("kind") == "class", "type")
            .when((fan_in == 0) & (fan_out > 0), "entry point")
            .when((fan_out >= 4) & (fan_in <= 1), "orchestrator")
            .when(fan_in >= 3, "shared helper")
            .otherwise("supporting"))


def scored_symbols(symbols: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """Every symbol with fan_in, fan_out, role and score."""
    names = exports.select("repo", "name").distinct()
    out = with_fan(symbols, edges)
    out = out.join(names.withColumn("in_exports", F.lit(True)), ["repo", "name"], "left")
    owners = names.select("repo", F.col("name").alias("owner_name"),
                          F.lit(True).alias("owner_exported"))
    out = (out.withColumn("owner_name", F.substring_index("owner_class", ".", -1))
           .join(owners, ["repo", "owner_name"], "left"))
    return (out.withColumn("role", role())
            .withColumn("score", score(F.coalesce("in_exports", F.lit(False)),
                                       F.coalesce("owner_exported", F.lit(False))))
            .drop("in_exports", "owner_exported", "owner_name"))


def top_per_repo(df: DataFrame, limit: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows of each repository in the given order, with their rank.

    Spark keeps ``limit`` rows per task before the shuffle, so one repository
    holding most of the rows is not sorted in one place.
    """
    w = W.partitionBy("repo").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


def narrow_scores(symbols: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """Scored symbols with the columns that lists of them show."""
    narrow = symbols.select("repo", "qualname", "name", "file", "start_line", "end_line", "kind",
                            "docstring", "owner_class", "line_count", "ord")
    return scored_symbols(narrow, edges, exports)


def top_scored(scored: DataFrame, top: int) -> DataFrame:
    return top_per_repo(scored, top, F.desc("score"), F.asc("qualname"))


def top_symbols(symbols: DataFrame, edges: DataFrame, exports: DataFrame, top: int) -> DataFrame:
    """The ``top`` scored symbols of each repository by (score desc, qualname)."""
    return top_scored(narrow_scores(symbols, edges, exports), top)


def as_notes(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked symbols with their callees. They are few and written first, so calls of all others are left unsorted."""
    ranked = cut_lineage(ranked.drop("name", "docstring", "owner_class", "line_count"))
    calls = callees(of_nodes(edges, "caller", ranked), 10).withColumnRenamed("names", "calls")
    return (ranked.join(calls, ["repo", "qualname"], "left")
            .withColumn("calls", F.coalesce("calls", F.expr("cast(array() as array<string>)"))))


def rank_symbols(symbols: DataFrame, edges: DataFrame, exports: DataFrame,
                 top: int) -> DataFrame:
    """The ``top`` notes of each repository by (score desc, qualname), with their callees."""
    return as_notes(top_symbols(symbols, edges, exports, top), edges)


def entry_points(scored: DataFrame, limit: int = 12) -> DataFrame:
    """Called by nothing, calling something: best score first, then definition order."""
    return top_per_repo(scored.where("fan_in = 0 and fan_out > 0"), limit,
                        F.desc("score"), F.asc("ord"))


def most_connected(fanned: DataFrame, limit: int = 8) -> DataFrame:
    """Largest fan-out first, then definition order; nothing without a call."""
    return top_per_repo(fanned.where("fan_out > 0"), limit, F.desc("fan_out"), F.asc("ord"))


def components(notes: DataFrame) -> DataFrame:
    """Notes grouped by file, largest group first, ties by the best-ranked note."""
    grouped = (notes.groupBy("repo", F.col("file").alias("module"))
               .agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"),
                    F.array_sort(F.collect_list(F.struct("rank", "qualname"))).alias("members")))
    w = W.partitionBy("repo").orderBy(F.desc("n"), F.asc("first_rank"))
    return grouped.select("repo", "module", "n", F.col("members.qualname").alias("symbols"),
                          F.row_number().over(w).alias("rank"))


def reading_order(notes: DataFrame, limit: int | None = fixed.READING_STEPS) -> DataFrame:
    """Entry points and orchestrators, or the first five notes when there are none.

    Without a limit all of them, for texts that may name every one.
    """
    flagged = notes.withColumn("way_in", F.col("role").isin("entry point", "orchestrator"))
    # Notes are a bounded top list per repository, so this window is small.
    any_way = F.max("way_in").over(W.partitionBy("repo"))
    kept = flagged.withColumn("any_way", any_way).where(
        F.col("way_in") | (~F.col("any_way") & (F.col("rank") <= 5)))
    step = F.row_number().over(W.partitionBy("repo").orderBy("rank"))
    ordered = kept.withColumn("step", step).drop("way_in", "any_way")
    return ordered if limit is None else ordered.where(F.col("step") <= limit)
