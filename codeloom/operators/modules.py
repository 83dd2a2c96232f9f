"""File-level views: calls between files, mutual pairs, folder and extension counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from .ranking import top_per_repo


def file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges that cross files: (repo, caller, callee, a, b)."""
    where = symbols.select("repo", "qualname", "file")
    a = where.withColumnsRenamed({"qualname": "caller", "file": "a"})
    b = where.withColumnsRenamed({"qualname": "callee", "file": "b"})
    return edges.join(a, ["repo", "caller"]).join(b, ["repo", "callee"]).where("a <> b")


def file_pair_counts(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return (file_edges(edges, symbols).groupBy("repo", "a", "b")
            .agg(F.count("*").alias("n"), F.min("ord").alias("ord")))


def module_edges(edges: DataFrame, symbols: DataFrame,
                 limit: int = fixed.MAX_MODULE_EDGES) -> DataFrame:
    """Heaviest file-to-file relations, ties by first call."""
    return top_per_repo(file_pair_counts(edges, symbols), limit, F.desc("n"), F.asc("ord"))


def edge_widths(module: DataFrame) -> DataFrame:
    """Pen width of each listed relation, relative to the heaviest of its repository."""
    heaviest = module.groupBy("repo").agg(F.max("n").alias("heaviest"))
    return (module.join(heaviest, "repo")
            .withColumn("width", F.round(1.0 + 2.5 * F.col("n") / F.col("heaviest"), 1)))


def mutual_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered (first, second) for which both directions exist.

    Both directions of a pair meet under one sorted key, so this is one grouped
    pass, not a self-join.
    """
    return (pairs.groupBy("repo", F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))
            .agg(F.max(F.col(a) < F.col(b)).alias("down"), F.max(F.col(a) > F.col(b)).alias("up"))
            .where("down and up").select("repo", "first", "second"))


def folder_counts(files: DataFrame, limit: int = 6) -> DataFrame:
    """Source files per top-level folder, largest first, ties by first path."""
    folder = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)) \
              .otherwise("(root)")
    counted = (files.groupBy("repo", folder.alias("folder"))
               .agg(F.count("*").alias("n"), F.min("path").alias("first_path")))
    return top_per_repo(counted, limit, F.desc("n"), F.asc("first_path"))


def extension_counts(files: DataFrame, limit: int = 3) -> DataFrame:
    """Files per extension, most frequent first, ties by first path."""
    counted = (files.where(text.base_name("path").contains("."))
               .where(~F.array_contains(F.split("path", "/"), ".git"))
               .groupBy("repo", text.suffix("path").alias("ext"))
               .agg(F.count("*").alias("n"), F.min("path").alias("first_path")))
    return top_per_repo(counted, limit, F.desc("n"), F.asc("first_path"))


def surface_counts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: symbols, distinct files and edges."""
    s = symbols.groupBy("repo").agg(F.count("*").alias("symbols"),
                                    F.countDistinct("file").alias("files"))
    e = edges.groupBy("repo").agg(F.count("*").alias("edges"))
    return s.join(e, "repo", "left").na.fill(0, ["edges"])
