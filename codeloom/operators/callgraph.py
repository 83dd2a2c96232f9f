"""Calls to edges: name resolution, inheritance, fan counts and adjacency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed, text
from ..session import as_table, ordinal
from .symbols import (Analysis, attribute_names, definitions, exported_names, parse_errors,
                      parse_files, unique_symbols)


#: Calls of a definition that are counted within its row; longer lists are grouped by a shuffle.
IN_ROW = 64


def call_sites(symbols: DataFrame) -> DataFrame:
    """Calls per caller, pre-aggregated: equal calls of one caller are one row with a count.

    ``symbols`` has one row per (repo, qualname), so equal calls of one caller are in one row.
    """
    of = symbols.select("repo", F.col("qualname").alias("caller"), "owner_class", "ord", "calls")
    few = of.where(F.size("calls") <= IN_ROW).withColumn("c", F.explode(F.array_distinct("calls"))).select(
        "repo", "caller", "owner_class", "c.simple", "c.display",
        F.size(F.filter("calls", lambda x: x == F.col("c"))).cast("long").alias("n"),
        ordinal("ord", (F.array_position("calls", F.col("c")) - 1).cast("int").alias("call_pos")).alias("call_ord"))
    site = of.where(F.size("calls") > IN_ROW).select("repo", "caller", "owner_class", "ord", F.posexplode("calls").alias("call_pos", "c"))
    many = (site.groupBy("repo", "caller", "owner_class",
                         F.col("c.simple").alias("simple"), F.col("c.display").alias("display"))
            .agg(F.count("*").alias("n"), F.min(ordinal("ord", "call_pos")).alias("call_ord")))
    return few.unionByName(many)


def name_index(symbols: DataFrame) -> DataFrame:
    """(repo, simple) to the number of definitions, and the definition when it is one."""
    return (symbols.groupBy("repo", F.col("name").alias("simple"))
            .agg(F.count("*").alias("matches"), F.min("qualname").alias("match")))


def _on_self(simple: str = "simple", display: str = "display") -> Column:
    s, d = F.col(simple), F.col(display)
    return F.col("owner_class").isNotNull() & (
        (d == F.concat(F.lit("self."), s)) | (d == F.concat(F.lit("super()."), s))
        | (d == F.concat(F.lit("cls."), s)))


def class_steps(symbols: DataFrame) -> DataFrame:
    """(repo, name, base, step): base-class names above each class name, in order.

    Classes of one name are followed together, so a name that very many classes carry is one
    row for each base name, not one for each pair of classes.
    """
    classes = symbols.where("kind = 'class'")
    return (classes.select("repo", "name", "ord", F.posexplode("bases").alias("base_pos", "base"))
            .groupBy("repo", "name", "base").agg(F.min(ordinal("ord", "base_pos")).alias("step")))


def _defined_in(symbols: DataFrame) -> DataFrame:
    """(repo, name, simple, targets): what classes of a name define, the first two by order.

    Two, because the asking class may carry the name too and does not answer itself.
    """
    classes = symbols.where("kind = 'class'").select(
        "repo", F.col("qualname").alias("owner_class"), F.col("name").alias("cls_name"),
        F.col("ord").alias("cls_ord"))
    members = (symbols.where("owner_class is not null")
               .select("repo", "owner_class", F.col("name").alias("simple"),
                       F.col("qualname").alias("target"))
               .join(classes, ["repo", "owner_class"]))
    nth = F.row_number().over(W.partitionBy("repo", "cls_name", "simple")
                              .orderBy("cls_ord", "target"))
    return (members.withColumn("nth", nth).where("nth <= 2")
            .groupBy("repo", F.col("cls_name").alias("name"), "simple")
            .agg(F.array_sort(F.collect_list(F.struct("nth", "target"))).alias("targets")))


def resolve_inherited(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """First class above ``owner`` (breadth first) that defines ``simple``.

    ``wanted`` has distinct (repo, owner, simple). Class names are followed level by level, each
    level written once as a table; what the names on the way define is looked up in one join at the end.
    """
    owners = wanted.select("repo", F.col("owner").alias("qualname")).distinct()
    steps = as_table(class_steps(symbols))
    level = as_table(
        symbols.where("kind = 'class'").join(owners, ["repo", "qualname"], "left_semi")
        .select("repo", F.col("qualname").alias("owner"), F.posexplode("bases").alias("pos", "name"))
        .groupBy("repo", "owner", "name").agg(F.min("pos").alias("pos"))
        .select("repo", "owner", "name", F.array(ordinal(
            F.lit(None).cast(steps.schema["step"].dataType["ord"].dataType).alias("ord"),
            F.col("pos").alias("base_pos"))).alias("path")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        above = (level.withColumnRenamed("name", "below")
                 .join(steps.withColumnRenamed("name", "below"), ["repo", "below"])
                 .select("repo", "owner", F.col("base").alias("name"),
                         F.concat("path", F.array("step")).alias("path"))
                 .groupBy("repo", "owner", "name").agg(F.min("path").alias("path")))
        for seen in levels:
            above = above.join(seen, ["repo", "owner", "name"], "left_anti")
        level = as_table(above)
    if not levels:
        return wanted.where("false").withColumn("target", F.lit(None).cast("string"))
    reached = reduce(DataFrame.unionByName, [
        lv.withColumn("level", F.lit(i)) for i, lv in enumerate(levels)])
    itself = F.concat_ws(".", "owner", "simple")
    other = F.filter("targets", lambda t: t["target"] != itself)
    return (wanted.join(reached, ["repo", "owner"]).join(_defined_in(symbols), ["repo", "name", "simple"])
            .withColumn("target", F.get(other, F.lit(0))["target"]).where("target is not null")
            .groupBy("repo", "owner", "simple")
            .agg(F.min_by("target", ordinal("level", "path")).alias("target")))


def resolve_self_calls(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, caller, owner_class, simple) to the method a call on self, super or cls means."""
    asked = (sites.where(_on_self())
             .select("repo", "caller", F.col("owner_class").alias("owner"), "simple").distinct()
             .withColumn("target", F.concat_ws(".", "owner", "simple")))
    quals = symbols.select("repo", F.col("qualname").alias("target"))
    own = asked.where("target <> caller").join(quals, ["repo", "target"], "left_semi")
    rest = asked.drop("target").join(own.select("repo", "caller", "simple"),
                                     ["repo", "caller", "simple"], "left_anti")
    above = resolve_inherited(rest.select("repo", "owner", "simple").distinct(), symbols)
    return (own.select("repo", "caller", "simple", "target")
            .unionByName(rest.join(above, ["repo", "owner", "simple"])
                         .select("repo", "caller", "simple", "target")))


def resolve_calls(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every call site with its outcome: `edge`, `recursion`, `ambiguous` or `missing`.

    The lookup side has one row per (repo, name), so a very common name costs a
    skewed probe side only, which AQE splits.
    """
    sites = as_table(sites.withColumn("on_self", _on_self()))
    by_self = resolve_self_calls(sites, symbols)
    on_self = F.coalesce("on_self", F.lit(False))
    plain = sites.where(~on_self).withColumn("target", F.lit(None).cast("string"))
    sites = sites.where(on_self).join(by_self, ["repo", "caller", "simple"], "left").unionByName(plain)
    open_calls = sites.where(F.col("target").isNotNull()
                             | ~F.col("simple").isin(*fixed.BUILTINS))
    looked = open_calls.join(name_index(symbols), ["repo", "simple"], "left")
    target = F.coalesce("target", F.when(F.col("matches") == 1, F.col("match")))
    return (looked.withColumn("callee", target)
            .withColumn("outcome", F.when(target == F.col("caller"), "recursion")
                        .when(target.isNotNull(), "edge")
                        .when(F.col("matches") > 1, "ambiguous").otherwise("missing"))
            .select("repo", "caller", "simple", "display", "n", "call_ord", "callee",
                    "matches", "outcome"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """Distinct edges with the position of the first call behind each."""
    return (resolved.where("outcome = 'edge'").groupBy("repo", "caller", "callee")
            .agg(F.min("call_ord").alias("ord")))


def self_owners(symbols: DataFrame) -> DataFrame:
    """(repo, owner_class): classes that may answer a call on self, by a definition under their name or by a base.

    Names of calls hold no dot, so what a class defines has the class as all but its last part.
    """
    def said(df: DataFrame, name: str | Column, answers: bool) -> DataFrame:
        return df.select("repo", text.col(name).alias("owner_class"), F.lit(answers).alias("answers"))

    under = said(symbols, F.regexp_extract("qualname", "^(.*)[.]", 1), True)
    derived = said(symbols.where("kind = 'class' and size(bases) > 0"), "qualname", True)
    asking = said(symbols.where("owner_class is not null"), "owner_class", False)
    # Grouped and not joined: neither side is small where there are many definitions.
    return (asking.unionByName(under).unionByName(derived).groupBy("repo", "owner_class")
            .agg(F.min("answers").alias("all_answer"), F.max("answers").alias("answered"))
            .where("answered and not all_answer").select("repo", "owner_class"))


def calls_looked_up(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sites with matches and match of their name, null where nothing carries it; calls of builtins fall out.

    What resolve_calls finds without calls on self, also for sites that are not resolved.
    """
    return sites.where(~F.col("simple").isin(*fixed.BUILTINS)).join(name_index(symbols), ["repo", "simple"], "left")


def calls_by_name(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sites with their callee where a single definition carries the name; the others fall out, in one join.

    What resolve_calls finds without calls on self. Sites need no caller by name, so they can stay narrow.
    """
    one = name_index(symbols).where("matches = 1").select("repo", "simple", F.col("match").alias("callee"))
    return sites.where(~F.col("simple").isin(*fixed.BUILTINS)).join(one, ["repo", "simple"])


def unresolved_calls(resolved: DataFrame) -> DataFrame:
    """(repo, caller, text, n, call_ord): unmatched calls, equal ones counted, first place kept."""
    return resolved.where("outcome in ('ambiguous', 'missing')").select(
        "repo", "caller",
        F.when(F.col("outcome") == "ambiguous",
               F.concat("display", F.lit(" (ambiguous: "), F.col("matches").cast("string"),
                        F.lit(")"))).otherwise(F.col("display")).alias("text"), "n", "call_ord")


def resolution_rate(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Per repository: distinct edges, unmatched calls and the percentage between them."""
    both = (edges.select("repo", F.lit(1).alias("e"), F.lit(0).cast("long").alias("u"))
            .unionByName(unresolved.select("repo", F.lit(0).alias("e"), F.col("n").alias("u"))))
    return (both.groupBy("repo").agg(F.sum("e").alias("edges"), F.sum("u").alias("unresolved"))
            .withColumn("pct", F.coalesce(F.try_divide(
                100.0 * F.col("edges"), F.col("edges") + F.col("unresolved")), F.lit(0.0))))


def fan_counts(edges: DataFrame) -> DataFrame:
    """fan_in and fan_out of every node with an edge, in one grouped pass."""
    ends = edges.select("repo", F.explode(F.array(
        F.struct(F.col("caller").alias("qualname"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("callee").alias("qualname"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("e"))
    return (ends.groupBy("repo", F.col("e.qualname").alias("qualname"))
            .agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out")))


def with_fan(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return (symbols.join(fan_counts(edges), ["repo", "qualname"], "left")
            .na.fill(0, ["fan_in", "fan_out"]))


def first_neighbours(edges: DataFrame, node: str, other: str, limit: int) -> DataFrame:
    """(repo, qualname, names): the first ``limit`` neighbours by name.

    The rank filter is pushed below the shuffle, so a hub sends at most ``limit``
    rows per task, however many edges it has.
    """
    rank = F.row_number().over(W.partitionBy("repo", node).orderBy(other))
    top = edges.select("repo", node, other).withColumn("rank", rank).where(F.col("rank") <= limit)
    return (top.groupBy("repo", F.col(node).alias("qualname"))
            .agg(F.array_sort(F.collect_list(other)).alias("names")))


def of_nodes(edges: DataFrame, end: str, nodes: DataFrame) -> DataFrame:
    """Edges whose ``end`` is among the nodes."""
    return edges.join(nodes.select("repo", F.col("qualname").alias(end)), ["repo", end], "left_semi")


def callees(edges: DataFrame, limit: int) -> DataFrame:
    return first_neighbours(edges, "caller", "callee", limit)


def callers(edges: DataFrame, limit: int) -> DataFrame:
    return first_neighbours(edges, "callee", "caller", limit)


def short_names(c: Column) -> Column:
    return F.transform(c, text.tail)


def analyze_files(files: DataFrame) -> Analysis:
    """Whole corpus: parse, settle duplicates, resolve calls, build the graph.

    Files are parsed once: the result becomes a table because five relations
    read it, each a few columns.
    """
    parsed = as_table(parse_files(files))
    symbols = as_table(unique_symbols(definitions(parsed)))
    resolved = as_table(resolve_calls(call_sites(symbols), symbols))
    return Analysis(files=files, symbols=symbols, edges=call_edges(resolved),
                    unresolved=unresolved_calls(resolved),
                    attributes=attribute_names(parsed), errors=parse_errors(parsed),
                    exports=exported_names(files, symbols))
