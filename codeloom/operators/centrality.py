"""How central definitions are in the call graph, and how that meets how often they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import as_table

DAMPING, TOLERANCE = 0.85, 1e-10
#: Rounds between two tables; the residual is measured there.
STRIDE = 5


def page_rank(symbols: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
              most_rounds: int = 300) -> DataFrame:
    """(repo, qualname, centrality): PageRank over the calls of each repository, scaled to a mean of 1.

    Restarts and the mass of definitions that call nothing are both spread evenly over the repository, so together
    they only scale the result: rounds of x = 1 + damping * (what callers pass on) are run and x is scaled at the
    end. Rounds end when, over STRIDE of them, no repository moves by more than tolerance of its sum, or after
    most_rounds. Self calls and edges to unknown names are left out. A round has one join and one grouped sum; a
    hub's callers are summed in part before the shuffle.
    """
    nodes = as_table(symbols.select("repo", "qualname").distinct())
    known = lambda c: nodes.select("repo", F.col("qualname").alias(c))
    arcs = edges.where("caller <> callee").select("repo", "caller", "callee").distinct() \
        .join(known("caller"), ["repo", "caller"], "left_semi").join(known("callee"), ["repo", "callee"], "left_semi")
    share = arcs.groupBy("repo", "caller").agg((F.lit(damping) / F.count("*")).alias("share"))
    arcs = as_table(arcs.join(share, ["repo", "caller"]).withColumnRenamed("caller", "qualname"))
    one = nodes.withColumn("x", F.lit(1.0))
    now, rounds = one, 0
    while rounds < most_rounds:
        before, steps = now, min(STRIDE, most_rounds - rounds)
        for _ in range(steps):
            passed = now.join(arcs, ["repo", "qualname"]).select("repo", F.col("callee").alias("qualname"), (F.col("x") * F.col("share")).alias("x"))
            now = one.unionByName(passed).groupBy("repo", "qualname").agg(F.sum("x").alias("x"))
        now, rounds = as_table(now), rounds + steps
        moved = (now.join(before.withColumnRenamed("x", "was"), ["repo", "qualname"]).groupBy("repo")
                 .agg((F.sum(F.abs(F.col("x") - F.col("was"))) / F.sum("x")).alias("r")).agg(F.max("r")).first()[0])
        if (moved or 0.0) <= tolerance:
            break
    mean = now.groupBy("repo").agg(F.avg("x").alias("mean"))
    return now.join(mean, "repo").select("repo", "qualname", (F.col("x") / F.col("mean")).alias("centrality"))


def churn(history: DataFrame) -> DataFrame:
    """(repo, qualname, changes): versions in which a definition is not what it was in the version before.

    history: repo, qualname, version (numbers without gaps), fingerprint. A definition that is missing from a
    version after it was there, or comes back, changed in that version; its first version is no change.
    """
    by = W.partitionBy("repo", "qualname").orderBy("version")
    last = history.groupBy("repo").agg(F.max("version").alias("last"))
    seen = history.select("*", F.lag("version").over(by).alias("v"), F.lag("fingerprint").over(by).alias("was"),
                          F.lead("version").over(by).alias("next")).join(last, "repo")
    gap = F.col("v").isNotNull() & (F.col("v") < F.col("version") - 1)
    differs = F.col("v").isNotNull() & ~F.col("was").eqNullSafe(F.col("fingerprint"))
    # Back after a gap is one change, going away (also for good) another.
    goes = F.coalesce(F.col("next") > F.col("version") + 1, F.col("version") < F.col("last"))
    return seen.groupBy("repo", "qualname").agg(
        F.sum(F.when(gap | differs, 1).otherwise(0) + F.when(goes, 1).otherwise(0)).alias("changes"))


def hot_spots(centrality: DataFrame, changes: DataFrame) -> DataFrame:
    """(repo, qualname, centrality, changes, heat): heat is their product; definitions never seen to change have 0."""
    both = centrality.join(changes, ["repo", "qualname"], "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    return both.withColumn("heat", F.col("centrality") * F.col("changes"))
