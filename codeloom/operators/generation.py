"""The language steps: what a model writes, with everything it is told and held to.

A model only words things. It is reached through ``Completer``; the default
needs no model and words the facts of each row with plain expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text
from ..schemas import CLAIM_REPLY, COMPONENT_REPLY, PURPOSE_REPLY
from .callgraph import callers, of_nodes, short_names


class Completer(Protocol):
    """Adds ``reply`` to rows that carry ``prompt`` next to the facts it was made from."""

    name: str

    def complete(self, df: DataFrame, task: str) -> DataFrame: ...


class FactCompleter:
    """Offline default: deterministic replies from the fact columns of each row."""

    name = "facts"

    def complete(self, df: DataFrame, task: str) -> DataFrame:
        return df.withColumn("reply", getattr(self, f"_{task}")())

    def _describe(self) -> Column:
        said = F.coalesce(F.nullif(text.first_line("docstring"), F.lit("")), F.concat(
            text.title_from_name("qualname"), F.lit(" as written in "), "file"))
        return F.to_json(F.struct(
            said.alias("purpose"), F.lit("none").alias("inputs"), F.lit("nothing").alias("returns"),
            F.lit("high").alias("confidence")))

    def _component(self) -> Column:
        return F.to_json(F.struct(
            text.title_from_name(F.regexp_replace(text.base_name("module"), r"\.[^.]+$", ""))
            .alias("title"),
            F.concat(F.lit("Holds "), F.array_join(short_names(F.col("symbols")), ", "), F.lit("."))
            .alias("summary")))

    def _write(self) -> Column:
        return F.concat("opening", F.coalesce(F.array_join("fact_lines", "\n"), F.lit("")))

    def _rewrite(self) -> Column:
        """Keep the sentences that no finding quotes or names."""
        kept = F.filter(text.sentences("body"), lambda s: ~F.exists(
            "flagged", lambda f: (f != "") & s.contains(f)))
        return F.array_join(kept, " ")

    def _claims(self) -> Column:
        """Sentences of the form: `a` calls `b`."""
        pattern = r"`([^`\n]+)`[^.`\n]*? calls `([^`\n]+)`"
        said = F.transform(text.sentences("body"), lambda s: F.struct(
            F.lit("calls").alias("type"), F.regexp_extract(s, pattern, 1).alias("subject"),
            F.regexp_extract(s, pattern, 2).alias("object"), s.alias("quote")))
        return F.to_json(F.struct(F.filter(said, lambda c: c["subject"] != "").alias("claims")))

    def _alternatives(self) -> Column:
        """Without a model nothing is proposed."""
        return F.lit('{"alternatives": []}')

    def _answer(self) -> Column:
        return F.to_json(F.struct(
            F.concat(F.lit("Start at "), F.array_join(F.transform("names", lambda q: F.concat(
                F.lit("`"), text.tail(q), F.lit("`"))), ", "), F.lit(".")).alias("answer"),
            F.lit("grounded").alias("coverage")))


class FunctionCompleter:
    """Calls ``ask(prompts) -> replies`` in the tasks, batch by batch, three attempts each.

    One task is one stage: all rows of a task go to the same model before the
    next task starts. When a batch fails, its prompts are asked one by one, each
    with attempts of its own; a prompt whose attempts all fail gets a null reply.
    """

    def __init__(self, ask: Callable[[list[str]], list[str]], name: str = "function",
                 attempts: int = 3):
        self.ask, self.name, self.attempts = ask, name, attempts

    def complete(self, df: DataFrame, task: str) -> DataFrame:
        ask, attempts = self.ask, self.attempts

        def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def asked(prompts: list[str], times: int) -> list[str | None] | None:
                for _ in range(times):
                    try:
                        got = list(ask(prompts))
                    except Exception:  # whatever a model client raises is one failed attempt
                        continue
                    if len(got) == len(prompts):
                        return got
                return None

            for prompts in batches:
                together = asked(list(prompts), 1)
                yield pd.Series(together if together is not None else [
                    (asked([p], attempts) or [None])[0] for p in prompts], dtype=object)

        udf = F.pandas_udf(replies, T.StringType()).asNondeterministic()
        return df.withColumn("reply", udf("prompt"))


def _facts(calls: str, called_by: str) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("definition "), "qualname"),
        F.concat(F.lit("in "), "file", F.lit(":"), F.col("start_line").cast("string"),
                 F.lit("-"), F.col("end_line").cast("string")),
        F.concat(F.lit("is a "), "kind"),
        F.when(F.size(calls) > 0, F.concat(F.lit("uses "), F.array_join(
            short_names(F.col(calls)), ", "))),
        F.when(F.size(called_by) > 0, F.concat(F.lit("used by "), F.array_join(
            short_names(F.col(called_by)), ", "))))


def describe_symbols(notes: DataFrame, symbols: DataFrame, edges: DataFrame,
                     completer: Completer) -> DataFrame:
    """Notes with purpose, inputs, returns and confidence.

    A source that had to be cut caps the confidence at medium; a reply that is
    no valid JSON leaves a marked note instead of stopping the run.
    """
    inn = callers(of_nodes(edges, "callee", notes), 6).withColumnRenamed("names", "called_by")
    j = (notes.join(symbols.select("repo", "qualname", "source", "docstring"), ["repo", "qualname"])
         .join(inn, ["repo", "qualname"], "left"))
    long = F.length("source") > fixed.DESCRIBE_SOURCE_CHARS
    shown = text.cut("source", fixed.DESCRIBE_SOURCE_CHARS, "\n# (cut here)")
    prompt = F.concat(_facts("calls", "called_by"), F.lit("\n\nSource:\n"), shown, F.lit(
        "\n\nAnswer as JSON with purpose (one plain sentence), inputs, returns and confidence "
        "(high, medium or low)."))
    told = completer.complete(j.withColumn("long", long).withColumn("prompt", prompt), "describe")
    r = told.withColumn("r", text.reply("reply", PURPOSE_REPLY))
    said = F.trim(F.coalesce("r.confidence", F.lit("medium")))
    return r.select(
        *notes.columns,
        F.when(F.col("r").isNull(), "(failed: no valid reply)")
        .otherwise(text.strip(F.coalesce("r.purpose", F.lit("")))).alias("purpose"),
        text.strip(F.coalesce("r.inputs", F.lit(""))).alias("inputs"),
        text.strip(F.coalesce("r.returns", F.lit(""))).alias("returns"),
        F.when(F.col("r").isNull(), "low").when(F.col("long") & (said == "high"), "medium")
        .otherwise(said).alias("confidence"))


def facts_of(df: DataFrame, keys: list[str], names: str, notes: DataFrame, line: Column) -> DataFrame:
    """(*keys, facts): one line for each note that a row lists by qualname, in the order of its list.

    Notes are the few chosen for a repository, so a row's lines are few too. Names without a note are left out.
    """
    listed = df.select(*keys, F.posexplode(names).alias("at", "qualname"))
    return (listed.join(notes.select("repo", "qualname", line.alias("line")), ["repo", "qualname"]).groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("s"))
            .select(*keys, F.array_join("s.line", "\n").alias("facts")))


def known_facts() -> Column:
    """What the graph knows about one note, for prompts: kind, role, place and the calls that were found."""
    return F.concat(text.tail("qualname"), F.lit(": "), "kind", F.lit(", "), "role", F.lit(", "), "file", F.lit(":"),
                    F.col("start_line").cast("string"), F.when(F.size("calls") > 0, F.concat(
                        F.lit("; uses "), F.array_join(short_names(F.col("calls")), ", "))).otherwise("; uses nothing known"))


def describe_components(components: DataFrame, completer: Completer, notes: DataFrame | None = None) -> DataFrame:
    """Components with a title and a summary; a failed reply falls back to the path.

    With notes, the prompt tells the kind, role and purpose of each piece.
    """
    asked = components.withColumn("facts", F.array_join(short_names(F.col("symbols")), ", "))
    if notes is not None:
        line = F.concat(text.tail("qualname"), F.lit(" ("), "kind", F.lit(", "), "role", F.lit("): "), "purpose")
        facts = facts_of(components, ["repo", "module"], "symbols", notes, line)
        asked = asked.withColumnRenamed("facts", "names").join(facts, ["repo", "module"], "left").withColumn(
            "facts", F.coalesce("facts", "names"))
    prompt = F.concat(F.lit("Module: "), "module", F.lit("\nPieces:\n"), "facts",
                      F.lit("\nAnswer as JSON with title and summary."))
    told = completer.complete(asked.withColumn("prompt", prompt), "component")
    r = told.withColumn("r", text.reply("reply", COMPONENT_REPLY))
    return r.select(
        *components.columns,
        text.strip(F.coalesce("r.title", F.col("module"))).alias("title"),
        F.when(F.col("r").isNull(), "(failed: no valid reply)")
        .otherwise(text.strip(F.coalesce("r.summary", F.lit("")))).alias("summary"))


def fact_line() -> Column:
    """What the writer is told about one note."""
    def told(label: str, c: str) -> Column:
        return F.when((F.coalesce(c, F.lit("")) != "")
                      & ~F.lower(c).isin(*fixed.NO_VALUE_WORDS), F.concat(F.lit(label), c))

    return F.concat_ws("\n", F.concat(F.lit("- `"), text.tail("qualname"), F.lit("` in `"),
                                      "file", F.lit("`: "), "purpose"),
                       told("  takes ", "inputs"), told("  gives ", "returns"),
                       F.when(F.col("confidence") == "low", "  (described with low confidence)"))


def _section(df: DataFrame, completer: Completer, place: Column, key: Column, heading: Column,
             kind: str, ask: str) -> DataFrame:
    known = F.array_join("known", "\n") if "known" in df.columns else F.lit("")
    told = completer.complete(df.withColumn("prompt", F.concat(
        "opening", F.array_join("fact_lines", "\n"), F.when(known != "", F.concat(
            F.lit("\n\nKnown from the call graph; say nothing about calls or places that differs from it:\n"), known))
        .otherwise(""), F.lit("\n\n" + ask))), "write")
    return told.select("repo", place.cast("int").alias("ord"), key.alias("key"),
                       heading.alias("heading"),
                       text.clean_body(F.coalesce("reply", F.lit(""))).alias("body"),
                       F.lit(kind).alias("kind"), "allowed", F.lit(1).alias("attempts"))


def write_sections(notes: DataFrame, components: DataFrame, reading: DataFrame,
                   entry: DataFrame, totals: DataFrame, completer: Completer,
                   max_components: int = 6) -> DataFrame:
    """Overview, one section per large component, and where to start reading."""
    none = F.array().cast("array<string>")

    def ordered(c: str, by: str = "rank") -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c])

    ways = entry.groupBy("repo").agg(ordered("qualname").alias("ways"))
    part = F.concat(F.lit("- "), "title", F.lit(" (in `"), "module", F.lit("`): "), "summary")
    parts = (components.withColumn("line", part).groupBy("repo")
             .agg(ordered("line").alias("fact_lines"), F.flatten(ordered("symbols")).alias("owned")))
    over = (totals.join(parts, "repo").join(ways, "repo", "left")
            .withColumn("opening", F.concat(
                "repo", F.lit(" has "), F.col("symbols").cast("string"),
                F.lit(" functions and classes with "), F.col("edges").cast("string"),
                F.lit(" verified calls between them. Its main parts:\n")))
            .withColumn("allowed", F.concat("owned", F.coalesce("ways", none))))
    overview = _section(over, completer, F.lit(0), F.lit("overview"),
                        F.lit("What this repository is"), "overview",
                        "Say what this repository is for and how it works, without function names.")
    lines = (notes.withColumn("line", fact_line()).withColumn("fact", known_facts())
             .groupBy("repo", F.col("file").alias("module"))
             .agg(ordered("line").alias("fact_lines"), ordered("fact").alias("known"), ordered("qualname").alias("allowed")))
    comp = (components.where(F.col("rank") <= max_components).join(lines, ["repo", "module"])
            .withColumn("opening", F.concat("summary", F.lit("\n"))))
    component = _section(comp, completer, F.col("rank"), F.concat(F.lit("component:"), "module"),
                         F.col("title"), "component",
                         "Explain this part: what it is for, then how its pieces hand over.")
    steps = (reading.withColumn("line", fact_line()).withColumn("fact", known_facts()).groupBy("repo")
             .agg(F.slice(ordered("line", "step"), 1, fixed.READING_STEPS).alias("fact_lines"),
                  F.slice(ordered("fact", "step"), 1, fixed.READING_STEPS).alias("known"),
                  ordered("qualname", "step").alias("allowed"))
             .withColumn("opening", F.lit("Read these first, in this order:\n")))
    first = _section(steps, completer, F.lit(max_components + 1), F.lit("reading-order"),
                     F.lit("Where to start reading"), "reading-order",
                     "Tell a newcomer what to read first, and why.")
    return overview.unionByName(component).unionByName(first)


def extract_claims(sections: DataFrame, completer: Completer) -> DataFrame:
    """Claims of every section: rows of the reply that name a subject."""
    prompt = F.concat(F.lit("List the claims of this text about code as JSON: type (calls, "
                            "location, parameter, behaviour), subject, object, quote.\n\n"), "body")
    prose = sections.withColumn("body", text.without_fences("body"))
    told = completer.complete(prose.withColumn("prompt", prompt), "claims")
    return (told.select("repo", F.col("key").alias("section_key"), F.posexplode(
                text.reply("reply", CLAIM_REPLY).getField("claims")).alias("ord", "c"))
            .where(F.coalesce("c.subject", F.lit("")) != "")
            .select("repo", F.concat_ws("#", "section_key", F.col("ord").cast("string"))
                    .alias("claim_id"), "section_key", "ord", "c.type", "c.subject", "c.object",
                    "c.quote"))


def rewrite_sections(sections: DataFrame, issues: DataFrame, feedback: DataFrame,
                     completer: Completer, notes: DataFrame | None = None) -> DataFrame:
    """Flagged sections written again, one more attempt each; a failed rewrite keeps the text.

    All flagged sections of a round go in one stage. Sections that passed are untouched. With notes,
    the prompt holds what the graph knows about the definitions a section may name.
    """
    flagged = issues.groupBy("repo", "key").agg(F.collect_set(F.when(
        F.coalesce("quote", F.lit("")) != "", F.col("quote")).otherwise(F.concat(
            F.lit("`"), "subject", F.lit("`")))).alias("flagged"))
    again = (sections.where("rewrite").join(feedback.withColumnRenamed("text", "told"),
                                            ["repo", "key"], "left")
             .join(flagged, ["repo", "key"], "left"))
    if notes is None:
        again = again.withColumn("facts", F.lit(None).cast("string"))
    else:
        again = again.join(facts_of(sections.where("rewrite"), ["repo", "key"], "allowed", notes, known_facts()),
                           ["repo", "key"], "left")
    prompt = F.concat(F.lit("Rewrite this section without the flagged claims.\nFindings:\n"),
                      F.coalesce("told", F.lit("")), F.when(F.col("facts").isNotNull(), F.concat(
                          F.lit("\n\nKnown from the call graph:\n"), "facts")).otherwise(""),
                      F.lit("\n\nText:\n"), "body")
    done = completer.complete(again.withColumn("prompt", prompt), "rewrite")
    new = done.withColumn("body", F.coalesce(text.clean_body("reply"), F.col("body"))) \
        .withColumn("attempts", F.when(F.col("reply").isNull(), F.col("attempts"))
                    .otherwise(F.col("attempts") + 1))
    return sections.where("not rewrite").unionByName(new.select(*sections.columns))
