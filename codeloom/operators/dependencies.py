"""Substitutes for dependencies: proposed names, settled against a table of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..schemas import ALTERNATIVES_REPLY
from ..session import as_table
from .retrieval import pair_dot, pair_similarity


def current_packages(packages: DataFrame) -> DataFrame:
    """Rows of the present schema version; an older row counts as absent."""
    return packages.where(F.col("_v") == fixed.PACKAGE_VERSION).drop("_v")


def asked_dependencies(deps: DataFrame) -> DataFrame:
    """(repo, dependency, place): the names looked into, in the order they are declared. deps: (repo, ord, spec)."""
    return (deps.where(F.col("ord") < fixed.MAX_ALTERNATIVE_DEPS)
            .select("repo", text.dependency_name("spec").alias("dependency"), "ord").where("dependency <> ''")
            .groupBy("repo", "dependency").agg(F.min("ord").alias("place")))


def propose_alternatives(deps: DataFrame, completer) -> DataFrame:
    """(repo, dependency, place, does, ord, candidate): what a model names, unchecked; one prompt for each repository.

    Every dependency that was asked about comes back. One without a usable answer has a single row with a null
    candidate, and so has every one of a repository whose reply is null or no valid JSON.
    """
    asked = asked_dependencies(deps)
    listed = asked.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", "dependency")))  # a few names
                                       .alias("s")).select("repo", F.col("s.dependency").alias("names"))
    prompt = F.concat(F.lit("A project needs these packages: "), F.array_join("names", ", "), F.lit(
        f".\nName for each its job in a few words, and at most {fixed.MAX_CANDIDATES} published packages that could do "
        "that job instead; none where nothing really can. No versions, and never the package itself.\n"
        "Answer as JSON with alternatives: a list of dependency, does and substitutes."))
    told = completer.complete(listed.withColumn("prompt", prompt), "alternatives")
    each = (told.select("repo", F.posexplode(text.reply("reply", ALTERNATIVES_REPLY).getField("alternatives"))
                        .alias("at", "a"))
            .select("repo", "at", text.dependency_name("a.dependency").alias("dependency"),
                    text.strip(F.coalesce("a.does", F.lit(""))).alias("does"), "a.substitutes")
            # A dependency that is answered twice keeps its first answer.
            .groupBy("repo", "dependency").agg(F.min_by(F.struct("does", "substitutes"), "at").alias("a")))
    return asked.join(each, ["repo", "dependency"], "left").select(
        "repo", "dependency", "place", F.coalesce("a.does", F.lit("")).alias("does"),
        F.posexplode_outer("a.substitutes").alias("ord", "candidate"))


def find_alternatives(deps: DataFrame, packages: DataFrame, completer) -> DataFrame:
    """Proposals settled against the packages, with the place and the job of each dependency.

    A dependency nothing was proposed for has one row with a null candidate.
    """
    proposed = as_table(propose_alternatives(deps, completer))
    about = proposed.select("repo", "dependency", "place", "does").distinct()
    judged = judge_alternatives(deps, proposed.where("candidate IS NOT NULL")
                                .select("repo", "dependency", "ord", "candidate"), packages)
    return about.join(judged, ["repo", "dependency"], "left")


def with_vectors(packages: DataFrame, embedder) -> DataFrame:
    """Packages with the vectors of their summaries, where the table brings none."""
    return packages if "embedding" in packages.columns else embedder.embed(packages.withColumn(
        "summary", F.coalesce("summary", F.lit(""))), "summary")


def judge_alternatives(deps: DataFrame, proposals: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, dependency, ord, candidate, relevance, summary, license, home, rejected): null ``rejected`` survives.

    ``deps`` has (repo, ord, spec), ``proposals`` (repo, dependency, ord, candidate)
    and ``packages`` (name, summary, requires, embedding, maybe license and home). The checks run in this
    order: exists, not built on the dependency, not dead, does a similar job.
    """
    asked = asked_dependencies(deps).drop("place")
    p = (proposals.where(F.col("ord") < fixed.MAX_CANDIDATES)
         .withColumn("dependency", text.dependency_name("dependency"))
         .withColumn("candidate", text.dependency_name("candidate"))
         .where("candidate <> '' and candidate <> dependency")
         .groupBy("repo", "dependency", "candidate").agg(F.min("ord").alias("ord"))
         .join(asked, ["repo", "dependency"], "left_semi"))
    rivals = asked.select("repo", F.col("dependency").alias("candidate"),
                          F.lit(True).alias("also_dependency"))
    extra = [F.col(c) if c in packages.columns else F.lit(None).cast("string").alias(c) for c in ("license", "home")]
    known = current_packages(packages).select(
        text.package_file_name("name").alias("key"), F.struct("summary", "requires", "embedding", *extra).alias("p"))
    known = known.groupBy("key").agg(F.max("p").alias("p")).select("key", "p.*")  # a package may be saved twice
    base = known.select(F.col("key").alias("dep_key"), F.col("summary").alias("dep_summary"),
                        F.col("embedding").alias("dep_embedding"))
    cand = known.withColumn("found", F.lit(True))
    j = (p.join(rivals, ["repo", "candidate"], "left")
         .withColumn("key", text.package_file_name("candidate"))
         .withColumn("dep_key", text.package_file_name("dependency"))
         .join(cand, "key", "left").join(base, "dep_key", "left"))
    both = (F.coalesce("dep_summary", F.lit("")) != "") & (F.coalesce("summary", F.lit("")) != "")
    relevance = F.when(both, pair_similarity("dep_embedding", "embedding")).otherwise(0.0)
    builds = F.coalesce(F.array_contains("requires", F.col("dependency")), F.lit(False)) \
        | F.coalesce("also_dependency", F.lit(False))
    dead = F.coalesce(F.col("summary").rlike(fixed.DEAD_SUMMARY), F.lit(False))
    # A small negative number keeps its sign when it is printed.
    number = F.format_number("relevance", 2)
    number = F.when((pair_dot("dep_embedding", "embedding") < 0) & (number == "0.00"), "-0.00") \
        .otherwise(number)
    reason = (F.when(F.col("found").isNull(), F.lit("no such package"))
              .when(builds, F.concat(F.lit("needs "), "dependency", F.lit(" itself")))
              .when(dead, F.lit("given up by its authors"))
              .when(both & (F.col("relevance") < fixed.MIN_RELEVANCE), F.concat(
                  F.lit("another purpose, similarity "), number)))
    judged = j.withColumn("relevance", relevance)
    return judged.select("repo", "dependency", "ord", "candidate",
                         F.when(reason.isNull(), F.col("relevance")).otherwise(0.0)
                         .alias("relevance"), "summary", "license", "home", reason.alias("rejected"))
