"""Usage examples taken from a repository's own tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed, text


def call_shape(name: str | Column) -> Column:
    """Pattern of a call of ``name``; \\b and \\w follow Unicode."""
    return F.concat(F.lit(r"(?U)\b"), text.quote_pattern(name), F.lit(r"\s*\("))


def mention_shape(name: str | Column) -> Column:
    return F.concat(F.lit(r"(?U)\b"), text.quote_pattern(name), F.lit(r"\b"))


def candidate_tests(test_symbols: DataFrame) -> DataFrame:
    return test_symbols.where(F.col("kind").isin("function", "method")
                              & F.col("name").startswith("test")
                              & (F.col("line_count") <= fixed.MAX_EXAMPLE_LINES))


def find_examples(wanted: DataFrame, test_symbols: DataFrame,
                  limit: int = fixed.MAX_EXAMPLES) -> DataFrame:
    """(repo, uses, rank, name, file, start_line, source): short direct tests first.

    Tests are indexed by the words they contain, so a wanted name meets only
    tests that mention it. A name that is not one word is checked as a pattern
    against the tests that hold its first word.
    """
    short = wanted.select("repo", text.tail("name").alias("uses")) \
        .where(F.length("uses") >= 3).distinct() \
        .withColumn("word", F.regexp_extract("uses", r"(?U)(\w+)", 1)).where("word <> ''")
    tests = candidate_tests(test_symbols)
    key = ["repo", "qualname"]
    called = F.regexp_extract_all("source", F.lit(r"(?U)\b(\w+)\s*\("), 1)
    # The index is narrow: the test's text is joined back for the rows that are kept.
    index = (tests.select(*key, "line_count", called.alias("called"), F.explode(F.array_distinct(
                 F.regexp_extract_all("source", F.lit(r"(?U)(\w+)"), 1))).alias("word"))
             .select(*key, "line_count", "word",
                     F.array_contains("called", F.col("word")).alias("direct")))
    met = index.join(short, ["repo", "word"])
    plain = met.where("uses = word").select("uses", *key, "line_count", "direct")
    odd = (met.where("uses <> word").select("uses", *key, "line_count")
           .join(tests.select(*key, "source"), key)
           .where(F.rlike("source", mention_shape("uses")))
           .select("uses", *key, "line_count",
                   F.rlike("source", call_shape("uses")).alias("direct")))
    rank = F.row_number().over(W.partitionBy("repo", "uses").orderBy(
        F.desc("direct"), F.asc("line_count"), F.asc("qualname")))
    best = plain.unionByName(odd).withColumn("rank", rank).where(F.col("rank") <= limit)
    return (best.drop("line_count", "direct")
            .join(tests.select(*key, "name", "file", "start_line", "source"), key)
            .select("repo", "uses", "rank", "name", "file", "start_line",
                    text.strip("source").alias("source")))


def example_candidates(hits: DataFrame, mentioned: Column, limit: int = 4) -> DataFrame:
    """Hits an answer talked about first, then the rest, four at most per repository."""
    w = W.partitionBy("repo").orderBy(F.desc("mentioned"), F.asc("rank"))
    return (hits.withColumn("mentioned", mentioned).withColumn("place", F.row_number().over(w))
            .where(F.col("place") <= limit))
