"""From source files to reviewed sections: analyse, map, write, review, revise."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import callgraph, claims, generation, modules, ranking, reviews, symbols
from ..operators.generation import Completer, FactCompleter
from ..operators.ranking import top_per_repo
from ..session import cut_lineage, ordinal
from ..sources import code_tree


class NothingToRead(RuntimeError):
    """The files hold no definition in a language that is understood."""


@dataclass
class State:
    """What a run has so far. Every relation is a DataFrame keyed by ``repo``."""

    files: DataFrame
    paths: DataFrame | None = None   # (repo, path) of every file
    analysis: symbols.Analysis | None = None
    notes: DataFrame | None = None
    components: DataFrame | None = None
    entry: DataFrame | None = None
    sections: DataFrame | None = None
    issues: DataFrame | None = None
    reviews: DataFrame | None = None
    round: int = 0
    log: list[str] = field(default_factory=list)


def limits(symbols: DataFrame, edges: DataFrame, unresolved: DataFrame,
           notes: DataFrame) -> DataFrame:
    """Per repository, the counted boundary of what its document covers."""
    s = symbols.groupBy("repo").agg(F.count("*").alias("total"))
    d = notes.groupBy("repo").agg(F.count("*").alias("described"))
    e = edges.groupBy("repo").agg(F.count("*").alias("edges"))
    vague = F.col("text").contains("ambiguous")
    u = unresolved.groupBy("repo").agg(
        F.sum("n").alias("unresolved"),
        F.sum(F.when(vague, F.col("n")).otherwise(0)).alias("ambiguous"))
    head = F.substring_index("text", ".", 1)
    outside = (unresolved.where(F.col("text").contains(".") & ~vague & ~head.isin("self", "cls"))
               .groupBy("repo", head.alias("head"))
               .agg(F.sum("n").alias("c"), F.min("call_ord").alias("first")))
    five = (top_per_repo(outside, 5, F.desc("c"), F.asc("first")).groupBy("repo")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "head"))).alias("s"))
            .select("repo", F.col("s.head").alias("external")))
    out = s
    for part in (d, e, u, five):
        out = out.join(part, "repo", "left")
    return out.na.fill(0, ["described", "edges", "unresolved", "ambiguous"])


def _no_definitions(files: DataFrame) -> NothingToRead:
    top = modules.extension_counts(files).groupBy("ext").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n")).limit(3).collect()
    return NothingToRead("no file in a known language. Mostly "
                         + ", ".join(f"{r.n} {r.ext}" for r in top)
                         + ". Python, JavaScript and TypeScript are read.")


def stage_analyze(st: State, subdir: str = "") -> None:
    code_tree.check_folder(st.paths, subdir)
    a = callgraph.analyze_files(code_tree.source_files(st.files, subdir=subdir))
    if a.symbols.isEmpty():
        raise _no_definitions(st.paths)
    a.edges, a.unresolved = cut_lineage(a.edges), cut_lineage(a.unresolved)
    a.exports = cut_lineage(symbols.exported_names(st.files, a.symbols))
    st.analysis = a


def stage_map(st: State, completer: Completer, top: int) -> None:
    a = st.analysis
    scored = cut_lineage(ranking.narrow_scores(a.symbols, a.edges, a.exports)
                         .drop("name", "docstring", "owner_class", "line_count"))
    ranked = cut_lineage(ranking.as_notes(ranking.top_scored(scored, top), a.edges))
    st.notes = cut_lineage(generation.describe_symbols(ranked, a.symbols, a.edges, completer))
    st.components = cut_lineage(
        generation.describe_components(ranking.components(st.notes), completer, st.notes))
    st.entry = cut_lineage(ranking.entry_points(scored).select("repo", "qualname", "rank"))


def stage_write(st: State, completer: Completer) -> None:
    totals = modules.surface_counts(st.analysis.symbols, st.analysis.edges)
    st.sections = cut_lineage(generation.write_sections(
        st.notes, st.components, ranking.reading_order(st.notes, None), st.entry, totals, completer))


def review_issues(sections: DataFrame, a: symbols.Analysis,
                  completer: Completer) -> tuple[DataFrame, DataFrame]:
    """(issues, claims) of all sections: invented names first, then failed claims in order."""
    found = cut_lineage(generation.extract_claims(sections, completer))
    known = reviews.known_names(a.symbols, a.attributes, reviews.mentioned(sections))
    names = reviews.name_issues(sections, known).select(
        "repo", "key", ordinal(F.lit(0).alias("pass"), F.lit(0).alias("at"), "subject").alias("ord"),
        "kind", "severity", "subject", "detail", F.lit("").alias("quote"))
    judged = cut_lineage(claims.judge_claims(found, cut_lineage(claims.named_symbols(found, a.symbols)), a.edges))
    failed = claims.explained(judged, a.symbols, a.edges).select(
        "repo", F.col("section_key").alias("key"),
        ordinal(F.lit(1).alias("pass"), F.col("ord").alias("at"), "subject").alias("ord"),
        "kind", "severity", "subject", "detail", "quote")
    return cut_lineage(names.unionByName(failed)), found


def stage_review(st: State, completer: Completer) -> None:
    st.issues, found = review_issues(st.sections, st.analysis, completer)
    st.reviews = cut_lineage(reviews.review_sections(st.sections, st.issues, found))


def stage_revise(st: State, completer: Completer) -> None:
    """One batch for every section that failed, whatever repository it is in."""
    flagged = reviews.failing(st.sections, st.reviews)
    told = reviews.feedback(st.issues, ["repo", "key"])
    again = generation.rewrite_sections(flagged, st.issues, told, completer, st.notes)
    st.sections = cut_lineage(again.drop("rewrite"))
    st.round += 1


def stages(files: DataFrame, top: int = 10, max_rounds: int = 2, subdir: str = "",
           completer: Completer | None = None,
           paths: DataFrame | None = None) -> Iterator[tuple[str, State]]:
    """Run stage by stage, yielding the state after each.

    ``paths`` lists every file, for steps that need no content; without it ``files`` does.
    """
    completer = completer or FactCompleter()
    st = State(files=files, paths=files.select("repo", "path") if paths is None else paths)

    def done(name: str) -> tuple[str, State]:
        st.log.append(name)
        return name, st

    stage_analyze(st, subdir)
    yield done("analyze")
    stage_map(st, completer, top)
    yield done("map")
    stage_write(st, completer)
    yield done("write")
    while True:
        stage_review(st, completer)
        yield done(f"review {st.round}")
        if st.round >= max_rounds or st.reviews.where("not passed").isEmpty():
            return
        stage_revise(st, completer)
        yield done(f"revise {st.round}")


def run(files: DataFrame, **options) -> State:
    state = None
    for _, state in stages(files, **options):
        pass
    return state


# ---- questions ---------------------------------------------------------------------------

def provenance() -> "F.Column":
    return (F.when(F.col("coverage") == "background",
                   "from general knowledge; nothing was looked up here")
            .when(F.col("coverage") == "insufficient",
                  "no source that was found answers this; nothing was checked")
            .when(F.col("passed").isNull(), "based on source, not checked")
            .when(F.col("passed"), "based on source; its claims hold in the call graph")
            .otherwise("based on source; some of its claims are wrong"))


def _example(hits: DataFrame, answered: DataFrame, tests: DataFrame) -> DataFrame:
    """(repo, example): the first test of the first hit that has one, hits named in the answer first."""
    from ..operators import examples
    grounded = hits.join(answered.where("coverage = 'grounded'").select("repo", "text"), "repo")
    named = F.array_contains(F.transform(text.mentions("text"), lambda m: F.regexp_replace(
        text.tail(m), r"\(\)$", "")), text.tail("qualname"))
    wanted = cut_lineage(examples.example_candidates(grounded, named)
                         .select("repo", "place", F.col("qualname").alias("name")))
    found = examples.find_examples(wanted, tests)
    return (found.join(wanted.select("repo", "place", text.tail("name").alias("uses")), ["repo", "uses"])
            .groupBy("repo").agg(F.min_by("source", ordinal("place", "rank")).alias("example")))


def ask(question: str, a: symbols.Analysis, vectors: DataFrame, vector: list[float],
        completer: Completer | None = None, k: int = 5, verify: bool = True,
        tests: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """(repo, text, coverage, best_score, sources, example, claims_checked, errors, passed, provenance).

    One answer per repository: search, answer from the hits, check the answer.
    A repository without any hit is answered as insufficient. ``sources`` are the hits with their
    scores. ``example`` is a test (from the definitions in ``tests``) that uses a hit: one that the
    answer names before the others; only answers about the source get one. ``summaries`` has
    (repo, summary), a line about each project for the prompt.
    """
    from ..operators import retrieval
    from ..schemas import ANSWER_REPLY
    completer = completer or FactCompleter()
    hits = cut_lineage(retrieval.search(vectors, vector, k))
    blocks = retrieval.answer_context(hits, a.symbols, a.edges)
    context = blocks.groupBy("repo").agg(F.array_sort(F.collect_list(
        F.struct("rank", "qualname", "block"))).alias("s")).select(
        "repo", F.col("s.qualname").alias("names"), F.array_join("s.block", "\n\n").alias("context"))
    if summaries is not None:
        context = context.join(summaries.select("repo", "summary"), "repo", "left")
    about = F.lit("") if summaries is None else F.when(F.coalesce("summary", F.lit("")) != "", F.concat(
        F.lit(" ("), "summary", F.lit(")"))).otherwise("")
    prompt = F.concat(F.lit("Project "), "repo", about, F.lit(f"\nQuestion: {question}\n\n"), "context",
                      F.lit("\n\nAnswer as JSON with answer and coverage (grounded, background or "
                            "insufficient)."))
    told = completer.complete(context.withColumn("prompt", prompt), "answer")
    r = told.withColumn("r", text.reply("reply", ANSWER_REPLY))
    said = F.coalesce("r.coverage", F.lit("grounded"))
    answered = cut_lineage(r.select(
        "repo", text.strip(F.coalesce("r.answer", F.lit(""))).alias("text"),
        F.when(said.isin("grounded", "background", "insufficient"), said).otherwise("grounded")
        .alias("coverage"), F.col("names").alias("allowed")))
    repos = a.symbols.select("repo").distinct()
    out = (repos.join(answered.drop("allowed"), "repo", "left")
           .join(retrieval.best_score(hits), "repo", "left").na.fill(0.0, ["best_score"])
           .withColumn("coverage", F.coalesce("coverage", F.lit("insufficient")))
           .withColumn("text", F.coalesce("text", F.lit(
               "No definition matches the question."))))
    sources = hits.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(  # k hits at most
        F.struct("rank", "qualname", "score"))), lambda h: F.struct(
            h["qualname"].alias("qualname"), h["score"].alias("score"))).alias("sources"))
    out = out.join(sources, "repo", "left")
    if tests is None:
        out = out.withColumn("example", F.lit(None).cast("string"))
    else:
        out = out.join(_example(hits, answered, tests), "repo", "left")
    if verify:
        section = answered.where("coverage = 'grounded'").select(
            "repo", F.lit("answer").alias("key"), F.lit(question[:60]).alias("heading"),
            F.lit(0).alias("ord"), F.col("text").alias("body"))
        issues, found = review_issues(section, a, completer)
        checked = reviews.review_sections(section, issues, found) \
            .select("repo", "claims_checked", "errors", "passed")
        out = out.join(checked, "repo", "left")
    else:
        out = out.withColumn("passed", F.lit(None).cast("boolean"))
    return out.withColumn("provenance", provenance())
