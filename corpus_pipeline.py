"""A corpus made ready for training: five stages, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.line_dedup import dedup_lines
from codeloom.llm.near_copies import similar_components
from codeloom.llm.packing import pack_documents
from codeloom.llm.pii import find_pii, redact
from codeloom.llm.queries import TOKENIZERS
from codeloom.llm.simhash_dedup import keep_first
from codeloom.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from codeloom.session import as_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """docs with another text and its length, in the order of columns."""
    changed = docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*[F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go; null and empty ones stay."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity.score") < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; every document stays, if need be with an empty text."""
    return _with_text(dedup_lines(docs), docs.columns, F.col("kept_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by similar texts (five words, 0.8) stays."""
    return keep_first(docs, similar_components(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; every document stays."""
    return _with_text(redact(find_pii(docs, out="__pii"), spans="__pii"), docs.columns, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return pack_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json", keep=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_copies", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Learned scores, shingle similarity and token ids are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
