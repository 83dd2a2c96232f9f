"""Command line: analyse, document or question a source tree (or a folder of them)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import callgraph, dependencies, findings, modules, retrieval, symbols
from .operators.generation import Completer, FactCompleter
from .operators.ranking import rank_symbols
from .operators.symbols import Analysis, exported_names
from .plans import document, render
from .session import as_table, build_session, drop_tables
from .sources import artifacts, code_tree, manifests
from .streaming.progress import follow

#: What words proposals; a program that has a model puts its own here.
COMPLETER: Completer = FactCompleter()


def deliver(df: DataFrame, args: argparse.Namespace) -> None:
    """Every row: to --out as JSON lines, or to the screen as they arrive.

    With --limit the screen shows that many and the number left out.
    """
    if args.out:
        df.write.mode("overwrite").json(f"{args.out}/{args.command}")
        return
    shown = df.limit(args.limit) if args.limit else df
    for row in shown.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
    if args.limit and (left := df.count() - args.limit) > 0:
        print(f"... {left} more rows; leave out --limit to see them")


def _analysis(listed: DataFrame, subdir: str) -> Analysis:
    """Definitions of the chosen folder; exports are read from the whole tree."""
    source = code_tree.contents(code_tree.source_files(listed))
    a = callgraph.analyze_files(source.where(code_tree.in_folder(subdir)))
    a.exports = exported_names(source, a.symbols)
    return a


def _manifest(listed: DataFrame) -> DataFrame:
    return manifests.read_manifest(
        code_tree.contents(listed.where(code_tree.packaging())),
        code_tree.contents(listed.where(F.col("path").endswith(".py"))), listed)


def _alternatives(manifest: DataFrame, root: str) -> DataFrame:
    """Substitutes for what the manifests ask for, looked up in the packages saved under root."""
    deps = manifest.select("repo", F.posexplode("dependencies").alias("ord", "spec"))
    packages = dependencies.with_vectors(artifacts.load_packages(manifest.sparkSession, root), retrieval.HashingEmbedder())
    return dependencies.find_alternatives(deps, packages, COMPLETER)


def main(argv: list[str] | None = None) -> None:
    spark = build_session()
    try:
        run(spark, argv)
    finally:
        drop_tables(spark)


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("command", choices=("files", "analyze", "rank", "findings", "manifest",
                                       "document", "alternatives", "search", "ask"))
    p.add_argument("root")
    p.add_argument("question", nargs="*")
    p.add_argument("--corpus", action="store_true", help="every folder in ROOT is a repository")
    p.add_argument("--subdir", default="")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--max-rounds", type=int, default=2)
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--out", default="", help="folder for results; the screen without it")
    p.add_argument("--packages", default="", help="folder of saved packages; with it a document names alternatives")
    p.add_argument("--limit", type=int, default=0, help="rows on the screen; all without it")
    args = p.parse_args(argv)
    if args.command == "alternatives" and not args.packages:
        p.error("alternatives needs --packages")
    listed = as_table(code_tree.list_tree(spark, args.root, args.corpus))
    if args.command == "files":
        kept = code_tree.source_files(listed, subdir=args.subdir)
        deliver(kept.select("repo", "path").orderBy("repo", "path"), args)
    elif args.command == "manifest":
        deliver(render.getting_started(_manifest(listed)), args)
    elif args.command == "alternatives":
        deliver(render.alternatives_text(as_table(_alternatives(_manifest(listed), args.packages))), args)
    elif args.command == "document":
        st, source = None, code_tree.source_files(listed)
        for stage, caption, st in follow(code_tree.contents(source), top=args.top,
                                         max_rounds=args.max_rounds, subdir=args.subdir,
                                         paths=listed.select("repo", "path")):
            print(f"[{stage}] {caption}")
        manifest = as_table(_manifest(listed))
        body = render.build_documents(st, manifest, source, as_table(_alternatives(manifest, args.packages))
                                      if args.packages else None)
        if args.out:
            counts = modules.surface_counts(st.analysis.symbols, st.analysis.edges)
            artifacts.save(artifacts.repo_map(st.notes, st.components, st.entry, counts),
                           args.out, "map")
            artifacts.save(artifacts.draft(st.sections), args.out, "draft")
            artifacts.save(artifacts.review(st.reviews, st.issues), args.out, "review")
            artifacts.save_markdown(render.draft_markdown(st.sections), args.out, "draft_text")
            artifacts.save_markdown(body, args.out)
        else:
            deliver(body, args)
    else:
        a = _analysis(listed, args.subdir)
        if args.command == "analyze":
            deliver(callgraph.resolution_rate(a.edges, a.unresolved), args)
        elif args.command == "rank":
            deliver(rank_symbols(a.symbols, a.edges, a.exports, args.top).drop("ord")
                    .orderBy("repo", "rank"), args)
        elif args.command == "findings":
            found = findings.findings(a.symbols, a.edges, a.exports, listed.select("repo", "path"))
            deliver(findings.findings_markdown(found), args)
        else:
            embed = retrieval.HashingEmbedder()
            asked = spark.createDataFrame([(" ".join(args.question),)], "text string")
            vector = list(embed.embed(asked, "text").first()["embedding"])
            chunks = retrieval.build_chunks(a.symbols, a.edges)
            if args.out:  # vectors of unchanged source are kept there and used again
                stale = artifacts.stale_repos(a, spark, args.out)
                artifacts.build_index(a, chunks.join(stale, "repo", "left_semi"), embed, args.out)
                vectors = artifacts.load(spark, args.out, "vectors").join(
                    listed.select("repo").distinct(), "repo", "left_semi").drop("version")
            else:
                vectors = embed.embed(chunks, "text")
            if args.command == "search":
                deliver(retrieval.search(vectors, vector, args.k).orderBy("repo", "rank"), args)
            else:
                tests = symbols.unique_symbols(symbols.definitions(symbols.parse_files(
                    code_tree.contents(code_tree.test_sources(listed)))))
                deliver(document.ask(" ".join(args.question), a, vectors, vector, k=args.k, tests=tests,
                                     summaries=_manifest(listed).select("repo", "summary")), args)


if __name__ == "__main__":
    main()
