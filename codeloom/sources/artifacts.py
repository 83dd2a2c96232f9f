"""Saved runs: maps, drafts, reviews, documents, vectors and the package cache, as tables.

Each kind is one Parquet table partitioned by repository name, so a run replaces
its own repositories and leaves the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions import fixed
from ..operators.symbols import Analysis
from ..schemas import ISSUE, SECTION

KINDS = ("map", "draft", "review")


def repo_map(notes: DataFrame, components: DataFrame, entry: DataFrame,
             counts: DataFrame) -> DataFrame:
    """(repo, total_symbols, total_edges, entry_points, components, notes): nested, bounded lists."""
    def nested(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.groupBy("repo").agg(F.array_sort(F.collect_list(
            F.struct("rank", *cols))).alias(name))

    own = [c for c in notes.columns if c not in ("repo", "rank", "ord")]
    return (counts.select("repo", F.col("symbols").alias("total_symbols"),
                          F.col("edges").alias("total_edges"))
            .join(nested(entry, "entry_points", "qualname"), "repo", "left")
            .join(nested(components, "components", "module", "title", "summary", "symbols"),
                  "repo", "left")
            .join(nested(notes, "notes", *own), "repo", "left"))


def draft(sections: DataFrame) -> DataFrame:
    s = F.struct("ord", *SECTION.names)
    return sections.groupBy("repo").agg(F.array_sort(F.collect_list(s)).alias("sections"))


def review(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per section with its issues in order."""
    found = issues.groupBy("repo", "key").agg(F.array_sort(F.collect_list(
        F.struct("ord", *ISSUE.names))).alias("issues"))
    return (reviews.join(found, ["repo", "key"], "left")
            .select("repo", F.col("key").alias("section_key"), "heading", "passed",
                    "claims_checked", "issues"))


def save(df: DataFrame, root: str, kind: str) -> None:
    """Replace the repositories that ``df`` holds; others stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("repo").parquet(f"{root}/{kind}"))


def load(spark: SparkSession, root: str, kind: str, repo: str | None = None) -> DataFrame:
    stored = spark.read.option("mergeSchema", "false").parquet(f"{root}/{kind}").schema
    named = T.StructType([T.StructField("repo", T.StringType()) if f.name == "repo" else f for f in stored])
    # Declared, because a name such as 007 would be read as a number from its folder.
    df = spark.read.schema(named).parquet(f"{root}/{kind}")
    return df if repo is None else df.where(F.col("repo") == repo)


def saved_repos(spark: SparkSession, root: str) -> DataFrame:
    """Repositories with a finished run."""
    return load(spark, root, "map").select("repo").distinct()


def load_all(spark: SparkSession, root: str, repo: str) -> dict[str, DataFrame]:
    """Map, draft and review of one repository: all of them or an error naming what is missing."""
    out, missing = {}, []
    for kind in KINDS:
        try:
            out[kind] = load(spark, root, kind, repo)
            if out[kind].isEmpty():
                missing.append(kind)
        except AnalysisException:
            missing.append(kind)
    if missing:
        raise FileNotFoundError(f"no saved {', '.join(missing)} for {repo!r} under {root}")
    return out


def save_markdown(df: DataFrame, root: str, kind: str = "final") -> None:
    """One text file per repository, written by the tasks; other repositories' files stay."""
    (df.select("repo", F.col("body").alias("value")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .option("lineSep", "\n").partitionBy("repo").text(f"{root}/{kind}"))


# ---- vectors and packages -------------------------------------------------------------------

def content_key(a: Analysis) -> DataFrame:
    """(repo, version): changes whenever a source changes, so an old index is never reused."""
    return a.symbols.groupBy("repo").agg(F.bit_xor(F.xxhash64("qualname", "source"))
                                         .cast("string").alias("version"))


def stale_repos(a: Analysis, spark: SparkSession, root: str) -> DataFrame:
    """Repositories whose vectors are missing or were built from other source."""
    now = content_key(a)
    try:
        have = load(spark, root, "vectors").select(F.col("repo").cast("string").alias("repo"),
                                                   "version").distinct()
    except AnalysisException:
        return now.select("repo")
    return now.join(have, ["repo", "version"], "left_anti").select("repo")


def build_index(a: Analysis, chunks: DataFrame, embedder, root: str) -> None:
    vectors = embedder.embed(chunks, "text").join(content_key(a), "repo")
    save(vectors, root, "vectors")


def save_packages(df: DataFrame, root: str) -> None:
    df.withColumn("_v", F.lit(fixed.PACKAGE_VERSION)).write.mode("append") \
        .parquet(f"{root}/packages")


def load_packages(spark: SparkSession, root: str) -> DataFrame:
    """Packages saved there; rows of another version of the table count as absent where they are looked up."""
    return spark.read.parquet(f"{root}/packages")
