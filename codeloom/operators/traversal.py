"""Bounded walks over the call graph, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..session import cut_lineage, ordinal
from .ranking import top_per_repo


def reach(seeds: DataFrame, edges: DataFrame, hops: int = fixed.MAX_PHASES) -> DataFrame:
    """(repo, start, node, depth): every node within ``hops`` calls of each seed.

    One join per level; only nodes not seen before go on, so cycles end by themselves.
    ``edges`` is a table: every level reads it, no copy is written.
    """
    step = edges.select("repo", F.col("caller").alias("node"), F.col("callee").alias("next"))
    seen = cut_lineage(seeds.select("repo", F.col("qualname").alias("start"),
                                    F.col("qualname").alias("node"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, hops + 1):
        frontier = cut_lineage(
            frontier.join(step, ["repo", "node"])
            .select("repo", "start", F.col("next").alias("node"), F.lit(depth).alias("depth"))
            .distinct().join(seen, ["repo", "start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # every level is written once
    return seen


def reach_size(reached: DataFrame) -> DataFrame:
    """(repo, qualname, depth, size): levels advanced and nodes seen per seed."""
    return (reached.groupBy("repo", F.col("start").alias("qualname"))
            .agg(F.max("depth").alias("depth"), F.count("*").alias("size")))


def diagram_nodes(notes: DataFrame, edges: DataFrame,
                  max_nodes: int = fixed.MAX_DIAGRAM_NODES) -> DataFrame:
    """(repo, qualname, place): ranked notes, then rings of neighbours until the budget is full.

    Within a ring the order is parent, callees before callers, name.
    """
    either = cut_lineage(
        edges.select("repo", F.col("caller").alias("near"), F.lit(0).alias("side"),
                     F.col("callee").alias("qualname"))
        .unionByName(edges.select("repo", F.col("callee").alias("near"), F.lit(1).alias("side"),
                                  F.col("caller").alias("qualname"))))
    chosen = cut_lineage(notes.where(F.col("rank") <= max_nodes)
                         .select("repo", "qualname", F.col("rank").alias("place")))
    frontier = chosen
    while True:
        open_repos = (chosen.groupBy("repo").agg(F.count("*").alias("taken"))
                      .where(F.col("taken") < max_nodes))
        near = frontier.select("repo", F.col("qualname").alias("near"), "place")
        ring = (near.join(open_repos, "repo").join(either, ["repo", "near"])
                .groupBy("repo", "taken", "qualname")
                .agg(F.min(ordinal("place", "side", "qualname")).alias("key"))
                .join(chosen, ["repo", "qualname"], "left_anti"))
        ring = top_per_repo(ring, max_nodes, F.asc("key"))
        frontier = cut_lineage(ring.where(F.col("rank") + F.col("taken") <= max_nodes)
                               .select("repo", "qualname",
                                       (F.col("rank") + F.col("taken")).cast("int").alias("place")))
        if frontier.isEmpty():
            return chosen
        chosen = chosen.unionByName(frontier)


def diagram_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends drawn."""
    a = nodes.select("repo", F.col("qualname").alias("caller"))
    b = nodes.select("repo", F.col("qualname").alias("callee"))
    return (edges.select("repo", "caller", "callee").join(a, ["repo", "caller"], "left_semi")
            .join(b, ["repo", "callee"], "left_semi"))


def connected_nodes(nodes: DataFrame, drawn: DataFrame) -> DataFrame:
    """Drawn nodes with at least one drawn edge."""
    ends = drawn.select("repo", F.explode(F.array("caller", "callee")).alias("qualname"))
    return nodes.join(ends, ["repo", "qualname"], "left_semi")


def flow_start(notes: DataFrame, edges: DataFrame, max_phases: int) -> DataFrame:
    """The note from which the longest flow starts; first ranked note on a tie."""
    calling = notes.join(edges.select("repo", F.col("caller").alias("qualname")),
                         ["repo", "qualname"], "left_semi")
    sized = calling.join(reach_size(reach(calling, edges, max_phases)), ["repo", "qualname"])
    bonus = F.when(F.col("role") == "entry point", 1.0) \
             .when(F.col("role") == "orchestrator", 2.0).otherwise(0.0)
    weight = F.col("score") / 100 + bonus
    return sized.groupBy("repo").agg(F.max_by(
        "qualname", ordinal("depth", "size", weight, -F.col("rank"))).alias("qualname"))


def phase_layers(notes: DataFrame, edges: DataFrame, max_phases: int = fixed.MAX_PHASES,
                 width: int = 4) -> DataFrame:
    """(repo, number, place, qualname): layers of calls from the flow's start.

    A callee counts as seen even when its layer had no room for it. ``edges`` is a table, as in ``reach``.
    """
    step = edges.select("repo", F.col("caller").alias("qualname"), "callee")
    described = notes.select("repo", "qualname", F.lit(0).alias("undescribed"))
    layer = cut_lineage(flow_start(notes, edges, max_phases)
                        .select("repo", F.lit(1).alias("number"), F.lit(1).alias("place"),
                                "qualname"))
    phases, seen = layer, layer.select("repo", "qualname")
    for number in range(2, max_phases + 1):
        fresh = cut_lineage(
            layer.join(step, ["repo", "qualname"]).select("repo", F.col("callee").alias("qualname"))
            .distinct().join(seen, ["repo", "qualname"], "left_anti"))
        if fresh.isEmpty():
            break
        ordered = fresh.join(described, ["repo", "qualname"], "left").na.fill(1, ["undescribed"])
        layer = cut_lineage(
            top_per_repo(ordered, width, F.asc("undescribed"), F.asc("qualname"), rank="place")
            .select("repo", F.lit(number).alias("number"), "place", "qualname"))
        phases = phases.unionByName(layer)
        seen = cut_lineage(seen.unionByName(fresh))
    return phases


def phase_flow(notes: DataFrame, symbols: DataFrame, edges: DataFrame,
               max_phases: int = fixed.MAX_PHASES) -> DataFrame:
    """(repo, number, title, symbols, detail): steps named by purpose, docstring or name."""
    layers = phase_layers(notes, edges, max_phases)
    grouped = (layers.groupBy("repo", "number")
               .agg(F.array_sort(F.collect_list(F.struct("place", "qualname"))).alias("s"))
               .select("repo", "number", F.col("s.qualname").alias("symbols")))
    lead = grouped.withColumn("qualname", F.element_at("symbols", 1))
    purpose = notes.select("repo", "qualname", "purpose") if "purpose" in notes.columns \
        else notes.select("repo", "qualname", F.lit("").alias("purpose"))
    lead = (lead.join(purpose, ["repo", "qualname"], "left")
            .join(symbols.select("repo", "qualname", "docstring"), ["repo", "qualname"], "left"))
    said = F.coalesce("purpose", F.lit(""))
    doc = F.coalesce(text.first_line("docstring"), F.lit(""))
    title = F.coalesce(F.nullif(text.short_purpose(said), F.lit("")),
                       F.nullif(text.short_purpose(doc), F.lit("")),
                       text.title_from_name("qualname"))
    return lead.select("repo", "number", title.alias("title"), "symbols",
                       F.when(said != "", said).otherwise(doc).alias("detail"))
