"""Cycles of the call graph and what depends on a definition, through any number of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import as_table

#: Above every number of a node.
_NONE = 2 ** 63 - 1


def _trimmed(arcs: DataFrame) -> DataFrame:
    """(repo, a, b) without arcs that lie on no cycle because nothing leads to them or away from them.

    Each round drops all arcs whose start has no caller or whose end has no callee; it ends when none is dropped.
    """
    left = arcs.count()
    while left:
        arcs = as_table(arcs.join(arcs.select("repo", F.col("b").alias("a")).distinct(), ["repo", "a"], "left_semi")
                        .join(arcs.select("repo", F.col("a").alias("b")).distinct(), ["repo", "b"], "left_semi"))
        now = arcs.count()
        if now == left:
            break
        left = now
    return arcs


def _spread(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """(repo, node, label): the smallest label among a node's own and those of all nodes that lead to it."""
    now = as_table(labels)
    moving = now
    while True:
        sent = (moving.join(arcs.withColumnRenamed("a", "node"), ["repo", "node"])
                .groupBy("repo", F.col("b").alias("node")).agg(F.min("label").alias("sent")))
        # Only nodes whose label fell send on in the next round.
        both = now.join(sent, ["repo", "node"], "left")
        now = as_table(both.select("repo", "node", F.least("label", "sent").alias("label"),
                                   (F.col("sent") < F.col("label")).eqNullSafe(True).alias("fell")))
        moving = now.where("fell").drop("fell")
        if moving.isEmpty():
            return now.drop("fell")


def cycles(edges: DataFrame) -> DataFrame:
    """(repo, qualname, component) for definitions on a cycle of two or more; component: the first by name.

    What no cycle can hold is trimmed away. Then, round by round, every node takes the smallest number that leads to
    it; nodes of one label from which that number's node can be reached backwards are its component. They leave and
    what is left is trimmed again, so each round settles one component for each label, wherever it lies.
    """
    # Rounds work on numbers; names come back at the end. The table holds them, so they are the same in every round.
    calls = edges.where("caller <> callee").select("repo", "caller", "callee").distinct()
    named = as_table(calls.select("repo", F.explode(F.array("caller", "callee")).alias("qualname")).distinct()
                     .withColumn("node", F.monotonically_increasing_id()))
    a, b = (named.select("repo", F.col("qualname").alias(end), F.col("node").alias(x)) for end, x in (("caller", "a"), ("callee", "b")))
    arcs = _trimmed(as_table(calls.join(a, ["repo", "caller"]).join(b, ["repo", "callee"]).select("repo", "a", "b")))
    found = None
    while not arcs.isEmpty():
        nodes = arcs.select("repo", F.explode(F.array("a", "b")).alias("node")).distinct()
        forward = _spread(nodes.withColumn("label", F.col("node")), arcs)
        a, b = (forward.select("repo", F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab")
        within = as_table(arcs.join(a, ["repo", "a"]).join(b, ["repo", "b"]).where("of_a = of_b")
                          .select("repo", "a", "b", F.col("of_a").alias("label")))
        # Backwards from each label's node: the smallest of a constant reaches what leads to it.
        start = forward.select("repo", "node", F.when(F.col("node") == F.col("label"), F.col("label"))
                               .otherwise(F.lit(_NONE)).alias("label"))
        back = _spread(start, within.select("repo", F.col("b").alias("a"), F.col("a").alias("b")))
        settled = as_table(back.where(F.col("label") != _NONE))
        found = settled if found is None else found.unionByName(settled)
        gone = settled.select("repo", "node")
        arcs = _trimmed(as_table(arcs.join(gone.withColumnRenamed("node", "a"), ["repo", "a"], "left_anti")
                                 .join(gone.withColumnRenamed("node", "b"), ["repo", "b"], "left_anti")))
    if found is None:
        return edges.select("repo", F.col("caller").alias("qualname"), F.col("caller").alias("component")).where("false")
    found = found.join(named, ["repo", "node"])
    first = found.groupBy("repo", "label").agg(F.count("*").alias("n"), F.min("qualname").alias("component")).where("n > 1")
    return found.join(first, ["repo", "label"]).select("repo", "qualname", "component")


def condensed(edges: DataFrame, on_cycles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (repo, qualname, component) of every node of an edge, and the arcs (repo, a, b) between components."""
    nodes = edges.select("repo", F.explode(F.array("caller", "callee")).alias("qualname")).distinct()
    members = as_table(nodes.join(on_cycles, ["repo", "qualname"], "left")
                       .withColumn("component", F.coalesce("component", "qualname")))
    a, b = (members.select("repo", F.col("qualname").alias(x), F.col("component").alias(y))
            for x, y in (("caller", "a"), ("callee", "b")))
    arcs = edges.join(a, ["repo", "caller"]).join(b, ["repo", "callee"]).where("a <> b").select("repo", "a", "b").distinct()
    return members, as_table(arcs)


def component_reach(starts: DataFrame, arcs: DataFrame) -> DataFrame:
    """(repo, of, at, depth): components that lead to each start (repo, of), itself at depth 0.

    Level by level over the condensed graph, which has no cycle; each level is written once.
    """
    up = arcs.select("repo", F.col("b").alias("at"), F.col("a").alias("above"))
    seen = frontier = as_table(starts.select("repo", "of", F.col("of").alias("at"), F.lit(0).alias("depth")))
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(up, ["repo", "at"]).select("repo", "of", F.col("above").alias("at"), F.lit(depth).alias("depth"))
        frontier = as_table(step.distinct().join(seen.select("repo", "of", "at"), ["repo", "of", "at"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def _reached(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of components, the seeds with their component, and what leads to these components."""
    members, arcs = condensed(edges, as_table(cycles(edges)))
    asked = seeds.select("repo", "qualname").distinct().join(members, ["repo", "qualname"]) \
        .select("repo", "qualname", F.col("component").alias("of"))
    return members, asked, component_reach(asked.select("repo", "of").distinct(), arcs)


def dependents(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, qualname, dependent, depth): all that reaches each seed by calls, however far, the seed left out.

    A cycle counts as one step: depth is the least number of steps between components, 0 on the seed's own cycle.
    """
    members, asked, reached = _reached(seeds, edges)
    return (asked.join(reached, ["repo", "of"])
            .join(members.select("repo", F.col("component").alias("at"), F.col("qualname").alias("dependent")), ["repo", "at"])
            .where("dependent <> qualname").select("repo", "qualname", "dependent", "depth"))


def blast_radius(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, qualname, dependents, depth, on_cycle): how many depend on each seed, how far the farthest is, and how
    many share the seed's cycle; zeros without edges. Sizes of components are added up, members are not listed.
    """
    members, asked, reached = _reached(seeds, edges)
    size = members.groupBy("repo", F.col("component").alias("at")).agg(F.count("*").alias("n"))
    summed = (reached.join(size, ["repo", "at"]).groupBy("repo", "of").agg(
        F.sum("n").alias("reached"), F.max("depth").alias("depth"),
        F.sum(F.when(F.col("depth") == 0, F.col("n")).otherwise(0)).alias("own")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (seeds.select("repo", "qualname").distinct()
            .join(asked.join(summed, ["repo", "of"]), ["repo", "qualname"], "left")
            .select("repo", "qualname", zero(F.col("reached") - 1).alias("dependents"), zero(F.col("depth")).alias("depth"),
                    zero(F.col("own") - 1).alias("on_cycle")))
