"""The registered queries of these operators and, where SQL can say it, their checks."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from .exact_dedup import exact_dedup
from .filter_audit import audit, failing_ids, text_conditions
from .line_dedup import dedup_lines
from .packing import pack_documents
from .pieces import decode_documents, encode_documents
from .pii import as_text, find_pii
from .quality import fit_quality, score_quality
from .simhash_dedup import as_hex, simhash_components
from .spelling import spelling_variants, word_counts
from .suffix_tree import score_texts
from .topk import exact_top_k
from .toxicity import THRESHOLD as TOXIC
from .toxicity import fit_toxicity, score_toxicity
from .url_rules import judge_urls, rules_from

#: The folder of the public tokenizer files is a parameter of the operators; this is the box's.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM t),
k AS (SELECT doc_id, p, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(f"""
WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256
      FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (norm)""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
                      F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("pii")).alias("spans"))


@query()
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                                             F.col("toxicity.score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{TOKENIZERS}/word_bpe_49k.json")
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


@query("""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
q AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, translate(
        regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        AS host FROM p),
m AS (SELECT page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
             max_by(verdict, length(r.host || r.path)) AS verdict
      FROM q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
      GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)""")
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_from(spark, _RULES))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT)
        AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts, ids and the digest of what they decode to, beside the digest of the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    file = f"{TOKENIZERS}/piece_bpe_32k.model"
    decoded = decode_documents(encode_documents(docs, file), file)
    return decoded.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"),
                          F.sha2("text", 256).alias("decoded_sha256"))


@query(f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
b(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order,
             [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM b a, b b, b c, b d, b e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
      FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failing = failing_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), text_conditions(F.col("text")), repeated="E")
    return audit(failing, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query()
def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from all documents but a seventh of the ids, scored on all."""
    away = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~away)
    return scored.scores.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                "base_score", "score", "from_one", "from_two")


@query()
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
