"""Drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import BLANKS, ascii_lower, fingerprint128, text_or_empty, without


def line_key(line: Column) -> Column:
    """What makes two lines the same: blanks stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Every input row with kept_text, n_lines (before dropping) and n_dropped.

    Lines are exploded as 128-bit hashes of their keys, counted once per document, and the positions of
    those found in at least min_docs documents are joined back to the text they came from. A position
    list belongs to a text, not to a row, so copies share one list and no row number is needed.

    Every row counts as a document, repeated rows too. A null text is an empty one: one empty line.
    Keys shorter than min_chars code points are never dropped. A text that loses all its lines becomes
    the empty string. Input columns called kept_text, n_lines or n_dropped are replaced.
    """
    source = text_or_empty(docs[f"`{text}`"])
    t1, t2 = fingerprint128(source)

    def hashed(line: Column, at: Column) -> Column:
        h1, h2 = fingerprint128(line_key(line))
        return F.struct(h1.alias("h1"), h2.alias("h2"), at.alias("at"),
                        (F.length(line_key(line)) >= min_chars).alias("long_enough"))

    in_order = F.sort_array(F.transform(F.split(source, "\n", -1), hashed))
    lines = (docs.select(t1.alias("t1"), t2.alias("t2"), in_order.alias("keys"))
             .select("t1", "t2", F.inline(F.transform("keys", lambda k, i: F.struct(
                 k["h1"].alias("h1"), k["h2"].alias("h2"), k["at"].alias("at"),
                 k["long_enough"].alias("long_enough"),
                 ((i == 0) | (F.get("keys", i - 1)["h1"] != k["h1"])
                  | (F.get("keys", i - 1)["h2"] != k["h2"])).alias("first")))))
             .where("long_enough").drop("long_enough"))
    lines = as_table(lines)

    common = (lines.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"))
              .where(F.col("n") >= min_docs).select("h1", "h2"))
    common = as_table(common)  # a side of its own, so that the lines of a very common one are split
    dropped = (lines.join(common, ["h1", "h2"], "left_semi")
               .groupBy("t1", "t2").agg(F.collect_set("at").alias("dropped")))
    dropped = as_table(dropped)  # likewise, so that the rows of a text with very many copies are split

    own = without(docs, "kept_text", "n_lines", "n_dropped")
    row = docs.select(F.struct(*own).alias("row") if own else F.struct(F.lit(0).alias("none")).alias("row"),
                      source.alias("source"), t1.alias("t1"), t2.alias("t2"))
    row = row.join(dropped, ["t1", "t2"], "left").withColumn("lines", F.split("source", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("source")).otherwise(
        F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
    return row.select(*([F.col("row.*")] if own else []), kept.alias("kept_text"),
                      F.size("lines").cast("long").alias("n_lines"),
                      F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
