"""Queries over documents, pages, suppliers, events, labels and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import dependencies, findings, model_calls, modules, retrieval, reviews
from ..operators.generation import FactCompleter
from ..operators.symbols import language, module_qualname
from ..schemas import _st
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import code_tree, manifests
from . import corpus, render
from .registry import query

# ---- vectors ------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str, repo: Column) -> DataFrame:
    """Vectors as chunks: the label is the symbol, so a symbol has many chunks."""
    return corpus.table(spark, sf_dir, "embeddings").select(
        repo.alias("repo"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("qualname"),
        F.lit("f.py").alias("file"), F.col("vec_id").cast("int").alias("start_line"),
        F.lit("function").alias("kind"), F.lit(1).alias("part"), F.lit(1).alias("n_parts"),
        "embedding")


def _asked(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row, the vector with id 0."""
    return corpus.table(spark, sf_dir, "embeddings").where("vec_id = 0") \
        .select("embedding").first()[0]


SIM = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
sim AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, q)"""


@query(f"""WITH {SIM},
near AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS near FROM sim QUALIFY near <= 40),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY label ORDER BY near) = 1)
SELECT 'label_' || label AS qualname, CAST(vec_id AS INTEGER) AS start_line, round(score, 6) AS score,
       '1/1' AS part, row_number() OVER (ORDER BY near) AS rank FROM best QUALIFY rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.search(_vectors(spark, sf_dir, F.lit("all")), _asked(spark, sf_dir), 10)
    return hits.select("qualname", "start_line", F.round("score", 6).alias("score"), "part",
                       F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SIM} SELECT label AS repo, round(max(score), 6) AS best_score FROM sim GROUP BY label
HAVING max(score) < 0.25""")
def low_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories (here: labels) in which the best hit is too weak to lean on."""
    hits = retrieval.search(_vectors(spark, sf_dir, F.col("label")), _asked(spark, sf_dir), 5)
    return retrieval.low_relevance(hits).select("repo", F.round("best_score", 6).alias("best_score"))


@query("""WITH lead AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 3) AS similarity
FROM embeddings JOIN lead USING (label)""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the first one of its label."""
    e = corpus.table(spark, sf_dir, "embeddings")
    lead = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("lead"))
    return e.join(lead, "label").select(
        "vec_id", retrieval.pair_similarity("embedding", "lead").alias("similarity"))


@query(f"""WITH {SIM},
near AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS near FROM sim QUALIFY near <= 40),
best AS (SELECT *, row_number() OVER (ORDER BY near) AS rank FROM (SELECT * FROM near QUALIFY
         row_number() OVER (PARTITION BY label ORDER BY near) = 1) QUALIFY rank <= 10)
SELECT 'label_' || label AS qualname, row_number() OVER (ORDER BY label % 2, rank) AS place FROM best
QUALIFY place <= 4""")
def example_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits an answer mentions (here: even labels) before the others."""
    from ..operators.examples import example_candidates as pick
    hits = retrieval.search(_vectors(spark, sf_dir, F.lit("all")), _asked(spark, sf_dir), 10)
    even = F.regexp_extract("qualname", "([0-9]+)$", 1).cast("int") % 2 == 0
    return pick(hits, even).select("qualname", F.col("place").cast("long").alias("place"))


# ---- chunk windows -----------------------------------------------------------------------------------

@query("""WITH RECURSIVE doc AS (
  SELECT doc_id, text, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM
    (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
pre AS (SELECT doc_id, text, l, list_transform(range(0, len(l) + 1), lambda n:
          coalesce(list_sum(list_transform(l[1:n], lambda x: length(x) + 1)), 0)) AS p FROM doc),
win AS (
  SELECT doc_id, 0 AS a, greatest(1, len(list_filter(p, lambda x: x <= 1000)) - 1) AS b FROM pre
  WHERE length(text) > 1000
  UNION ALL
  SELECT doc_id, n AS a, greatest(n + 1, len(list_filter(p, lambda x: x <= 1000 + p[n + 1])) - 1) AS b
  FROM (SELECT doc_id, greatest(a + 1, b - 8) AS n, b FROM win) JOIN pre USING (doc_id)
  WHERE b < len(l)),
every AS (
  SELECT doc_id, a AS line_off, array_to_string(l[a + 1:b], chr(10)) AS body FROM win JOIN pre USING (doc_id)
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 1000)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_off) AS INTEGER) AS part,
  CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_parts, CAST(line_off AS INTEGER) AS line_off,
  md5(body) AS body FROM every""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    return (retrieval.with_windows(d, F.col("text"))
            .select("doc_id", "part", "n_parts", "line_off", F.md5("window").alias("body")))


# ---- names in prose -----------------------------------------------------------------------------------

def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections: long words in backticks, every second line as fenced code."""
    body = F.replace("text", F.lit("tion"), F.lit("_tion"))
    body = F.regexp_replace(body, "([A-Za-z_]{6,})", "`$1`")
    body = F.regexp_replace(body, "\n([^\n]*)\n", "\n```\n$1\n```\n")
    return corpus.table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("repo"), F.col("doc_id").alias("key"), body.alias("body"))


@query("""WITH s AS (SELECT doc_id AS key, regexp_replace(regexp_replace(replace(text, 'tion', '_tion'),
    '([A-Za-z_]{6,})', '`\\1`', 'g'), '\\n([^\\n]*)\\n', chr(10) || '```' || chr(10) || '\\1' || chr(10) ||
    '```' || chr(10), 'g') AS body FROM documents),
known AS (SELECT DISTINCT unnest(regexp_extract_all(replace(text, 'tion', '_tion'), '[A-Za-z_]{6,}')) AS name
          FROM benchmark),
shown AS (SELECT DISTINCT key, unnest(regexp_extract_all(b, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM
  (SELECT key, unnest(regexp_extract_all(body, '```[^\\n]*\\n(.*?)```', 1, 's')) AS b FROM s)),
tok AS (SELECT DISTINCT key, trim(unnest(regexp_extract_all(regexp_replace(body, '```.*?```', ' ', 'gs'),
        '`([^`\\n]+)`', 1))) AS token FROM s)
SELECT key, token AS subject, CASE WHEN shown.token IS NOT NULL THEN 'unverifiable' ELSE 'unknown-name' END AS kind,
  CASE WHEN shown.token IS NULL AND (contains(tok.token, '_') OR regexp_matches(tok.token, '[A-Z].*[A-Z]')) THEN 'error' ELSE 'warning' END AS severity
FROM tok LEFT JOIN shown USING (key, token) WHERE token NOT IN (SELECT name FROM known)
  AND NOT regexp_matches(token, '[\\s/\\[\\]{}=,]|^\\.|\\.py$')""")
def ungrounded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every backticked word of every document that the benchmark texts do not know."""
    words = F.regexp_extract_all(F.replace("text", F.lit("tion"), F.lit("_tion")),
                                 F.lit("([A-Za-z_]{6,})"), 1)
    known = corpus.table(spark, sf_dir, "benchmark").select(
        F.lit("corpus").alias("repo"), F.explode(words).alias("name")).distinct()
    return reviews.name_issues(document_sections(spark, sf_dir), known) \
        .select("key", "subject", "kind", "severity")


PAGE_SQL = """page AS (SELECT page_id, replace(replace(replace(replace(replace(html, 'var ', ''),
  '<script>', chr(10) || '```js' || chr(10)), '</script>', chr(10) || '```' || chr(10)),
  '<style>', chr(10) || '```' || chr(10)), '</style>', chr(10) || '```' || chr(10)) AS body FROM pages)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown-like text: scripts and styles become fenced code."""
    body = F.replace("html", F.lit("var "), F.lit(""))
    for tag, mark in (("<script>", "\n```js\n"), ("</script>", "\n```\n"),
                      ("<style>", "\n```\n"), ("</style>", "\n```\n")):
        body = F.replace(body, F.lit(tag), F.lit(mark))
    return corpus.table(spark, sf_dir, "pages").select("page_id", body.alias("body"))


@query(f"""WITH {PAGE_SQL}, b AS (SELECT page_id, regexp_extract_all(body, '```([^\\n`]*)\\n(.*?)```', 1, 's') AS ls,
  regexp_extract_all(body, '```([^\\n`]*)\\n(.*?)```', 2, 's') AS bs FROM page)
SELECT page_id, CAST(i AS INTEGER) AS pos, CASE WHEN ls[i + 1] = '' THEN 'text' ELSE ls[i + 1] END AS lang,
  trim(bs[i + 1], chr(10) || ' ') AS body FROM b, unnest(range(0, len(ls))) t(i)""")
def fenced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.posexplode(text.fenced("body"))) \
        .select("page_id", "pos", "col.lang", "col.body")


@query(f"""WITH {PAGE_SQL} SELECT page_id, length(regexp_replace(body, '```.*?```', ' ', 'gs')) AS prose_chars,
  array_to_string(list_sort(list_distinct(list_concat(flatten(list_transform(regexp_extract_all(body, '```.*?```', 0, 's'),
    lambda x: regexp_extract_all(x, '(?m)^\\s*(\\w+)\\s*=[^=]', 1)))))), ',') AS names FROM page""")
def self_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names each page's own code introduces, and the length of its prose."""
    return _pages(spark, sf_dir).select(
        "page_id", F.length(text.without_fences("body")).cast("long").alias("prose_chars"),
        F.array_join(F.array_sort(text.self_defined("body")), ",").alias("names"))


@query("""SELECT doc_id, CAST(1 + length(t) - length(regexp_replace(t, '([.!?])\\s+', '\\1', 'g'))
  - coalesce(list_sum(list_transform(regexp_extract_all(t, '[.!?](\\s+)', 1), lambda x: length(x) - 1)), 0) AS BIGINT) AS sentences
FROM (SELECT doc_id, text AS t FROM documents)""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(text.sentences("text")).cast("long")
        .alias("sentences"))


@query(f"""WITH c AS (SELECT doc_id, trim(regexp_extract(trim(text, chr(10) || ' '),
    '^(.*?)(?:[,.;]| by | which | that |$)', 1, 's'), chr(10) || ' ') AS clause FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(clause, '\\s+')[1:7], lambda x: x <> '') AS p FROM c),
k AS (SELECT doc_id, p, coalesce(list_max(list_filter(range(1, len(p) + 1), lambda i: NOT list_contains(
  [{', '.join("'" + w + "'" for w in fixed.TRAILING_WORDS)}], trim(lower(p[i]), '.,''"')))), 0) AS n FROM w),
o AS (SELECT doc_id, rtrim(array_to_string(p[1:n], ' '), ' .,') AS s FROM k)
SELECT doc_id, upper(s[1]) || s[2:] AS label FROM o""")
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First clause of every document as a label."""
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", text.short_purpose("text").alias("label"))


def _leaky() -> Column:
    dashed = F.replace("text", F.lit(", "), F.lit(" — "))
    labelled = F.replace(dashed, F.lit(" the "), F.lit(" (Entry Point) the "))
    return F.when(F.col("lang") == "en", F.concat(labelled, F.lit(
        "\n\nCalls (verified): - `x`\nmore"))).otherwise(labelled)


@query("""SELECT doc_id, md5(trim(replace(t, ' — ', ', '), chr(10) || ' ')) AS body FROM (
  SELECT doc_id, replace(text, ', ', ' — ') AS t FROM documents)""")
def clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model prose tidied: leaked fact lines cut, role labels and dashes gone."""
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.clean_body(_leaky())).alias("body"))


# ---- paths --------------------------------------------------------------------------------------------

URL_SQL = """path AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*\\.(com|net|org)/', 1) AS repo,
  CASE WHEN l = 'de' THEN 'docs/' WHEN l = 'fr' THEN 'pkg/tests/' WHEN l = 'es' THEN 'src/pkg/' ELSE '' END || n ||
  CASE WHEN url LIKE '%//www.%' THEN '.py' WHEN url LIKE '%//m.%' THEN '.test.js'
       WHEN url LIKE '%//blog.%' THEN '/index.ts' ELSE '.md' END AS path, l
  FROM (SELECT *, regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1) AS l,
        regexp_extract(url, '^https?://[^/]*/[a-z]+/([0-9]+)', 1) AS n FROM pages))"""


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as paths of three repositories; language and host pick folder and suffix."""
    part = F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1)
    number = F.regexp_extract("url", "^https?://[^/]*/[a-z]+/([0-9]+)", 1)
    folder = F.when(part == "de", "docs/").when(part == "fr", "pkg/tests/") \
              .when(part == "es", "src/pkg/").otherwise("")
    ending = F.when(F.col("url").contains("//www."), ".py") \
              .when(F.col("url").contains("//m."), ".test.js") \
              .when(F.col("url").contains("//blog."), "/index.ts").otherwise(".md")
    return corpus.table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://[^/]*\.(com|net|org)/", 1).alias("repo"),
        F.concat(folder, number, ending).alias("path"))


@query(f"""WITH {URL_SQL} SELECT page_id, repo, path,
  CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript'
       WHEN path LIKE '%.ts' THEN 'typescript' END AS lang,
  l = 'de' AS skipped, l = 'fr' OR path LIKE '%.test.js' AS is_test,
  replace(regexp_replace(regexp_replace(regexp_replace(path, '\\.[a-z]+$', ''), '^src/', ''), '/index$', ''),
          '/', '.') AS module FROM path""")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_paths(spark, sf_dir).select(
        "page_id", "repo", "path", language("path").alias("lang"),
        code_tree.skipped().alias("skipped"), code_tree.is_test_path().alias("is_test"),
        module_qualname("path").alias("module"))


@query(f"""WITH {URL_SQL} SELECT repo, folder, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY
  count(*) DESC, min(path)) AS rank FROM (SELECT *, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1)
  ELSE '(root)' END AS folder FROM path WHERE l NOT IN ('de', 'fr') AND path NOT LIKE '%.test.js'
  AND path NOT LIKE '%.md') GROUP BY repo, folder QUALIFY rank <= 6""")
def module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_tree.suggest_subdirs(url_paths(spark, sf_dir)).select(
        "repo", "folder", "n", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {URL_SQL} SELECT repo, ext, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY
  count(*) DESC, min(path)) AS rank FROM (SELECT *, regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext FROM path)
  GROUP BY repo, ext QUALIFY rank <= 3""")
def extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.extension_counts(url_paths(spark, sf_dir)).select(
        "repo", "ext", "n", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {URL_SQL} SELECT repo, count(*) AS n FROM path WHERE l = 'fr' AND path LIKE '%.py' GROUP BY repo""")
def test_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = F.regexp_replace("path", "^pkg/tests/", "tests/unit/test_")
    return findings.test_file_count(url_paths(spark, sf_dir).withColumn("path", renamed))


@query("""SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1),
  '\\.git$', '') AS name FROM pages""")
def repo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id",
                                                      text.repo_from_url("url").alias("name"))


# ---- reviews and logs ------------------------------------------------------------------------------------

def label_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as issues: a toxic document is an error, a poor one a warning."""
    label = corpus.table(spark, sf_dir, "labels")
    doc = corpus.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    each = F.array(
        F.struct(F.lit(0).alias("ord"), (F.col("toxic") == 1).alias("on"), F.lit("error").alias(
            "severity"), F.lit("false-call").alias("kind")),
        F.struct(F.lit(1).alias("ord"), (F.col("quality") == 0).alias("on"), F.lit("warning").alias(
            "severity"), F.lit("unverifiable").alias("kind")))
    return (label.join(doc, "doc_id").select("doc_id", "source", "lang", F.explode(each).alias("i"))
            .where("i.on").select("doc_id", F.col("source").alias("repo"), "i.ord", "i.severity",
                                  "i.kind", F.concat(F.lit("about "), "lang").alias("detail"),
                                  F.lit(" said so ").alias("quote")))


@query("""SELECT source AS repo, count(*) FILTER (toxic = 1) AS errors, count(*) FILTER (quality = 0) AS warnings,
  count(*) FILTER (toxic = 1) = 0 AS passed FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0
GROUP BY source""")
def review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.review_rollup(label_issues(spark, sf_dir), ["repo"])


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN '- [error] false-call: about ' || lang || chr(10) ||
  '  about: "said so"' || CASE WHEN quality = 0 THEN chr(10) ELSE '' END ELSE '' END ||
  CASE WHEN quality = 0 THEN '- [warning] unverifiable: about ' || lang || chr(10) ||
  '  about: "said so"' ELSE '' END AS text
FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0""")
def feedback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.feedback(label_issues(spark, sf_dir), ["doc_id"])


@query("""SELECT doc_id, source AS repo, coalesce(toxic = 1, false) AS rewrite FROM documents LEFT JOIN labels
USING (doc_id)""")
def sections_to_revise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections, and which of them their review sends back."""
    tally = reviews.review_rollup(label_issues(spark, sf_dir).withColumn("key", F.col("doc_id")),
                                  ["repo", "key"])
    sections = corpus.table(spark, sf_dir, "documents").select(F.col("source").alias("repo"),
                                                               F.col("doc_id").alias("key"))
    return reviews.failing(sections, tally).select(F.col("key").alias("doc_id"), "repo", "rewrite")


def _log(spark: SparkSession, sf_dir: str, run: Column) -> DataFrame:
    """Events as a log of model calls: type is the model, value the seconds, k the tokens."""
    return corpus.table(spark, sf_dir, "events").select(
        run.cast("string").alias("run"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("model"), F.col("value").alias("seconds"),
        F.get_json_object("props", "$.k").cast("double").alias("output_tokens"))


def _stats_sql(run: str) -> str:
    return f"""WITH e AS (SELECT CAST({run} AS VARCHAR) AS run, event_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  lag(event_type) OVER (PARTITION BY {run} ORDER BY event_id) AS prev FROM events),
t AS (SELECT run, count(*) AS calls, round(sum(value), 4) AS seconds, CAST(sum(k) AS BIGINT) AS output_tokens,
  count(*) FILTER (prev <> event_type) AS swaps, sum(k) / sum(value) AS r FROM e GROUP BY run)
SELECT run, calls, seconds, output_tokens, swaps, round(r, 6) AS tokens_per_sec, swaps * 4 > calls AS thrash FROM t"""


def _stats(log: DataFrame) -> DataFrame:
    return reviews.call_stats(log).select(
        "run", "calls", F.round("seconds", 4).alias("seconds"), "output_tokens", "swaps",
        F.round("tokens_per_sec", 6).alias("tokens_per_sec"), "thrash")


@query(_stats_sql("'all'"))
def call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log as one run."""
    return _stats(_log(spark, sf_dir, F.lit("all")))


@query(_stats_sql("user_id"))
def call_stats_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_log(spark, sf_dir, F.col("user_id")))


@query("SELECT 'all' AS run, event_type AS model, count(*) AS calls FROM events GROUP BY event_type")
def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.model_counts(_log(spark, sf_dir, F.lit("all")))


def _title_words(prompts: list[str], settings: model_calls.Settings) -> list[str]:
    """A stand-in for a model: words each prompt anew."""
    return [p.removeprefix("Name ").title() for p in prompts]


@query("""WITH p AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_size AS said, p_size > 25 AS later FROM part)
SELECT CASE WHEN later THEN 'later' ELSE 'first' END AS run, count(*) AS calls,
       CAST(sum(len(string_split(said, ' '))) AS BIGINT) AS output_tokens, 0::BIGINT AS swaps FROM p GROUP BY later""")
def kept_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one table of replies: the first knows the smaller parts, the later one all, and asks what is new."""
    calls = f"{ensure_checkpoint_dir(spark)}/calls-{uuid.uuid4().hex}"
    parts = corpus.table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.concat_ws(" ", F.lit("Name"), "p_name", "p_type", "p_size").alias("prompt"))
    for run, rows in (("first", parts.where("p_size <= 25")), ("later", parts)):
        model_calls.KeptCompleter(_title_words, calls, run, batch=256).complete(rows, "name")
    return reviews.call_stats(model_calls.read_calls(spark, calls)).select("run", "calls", "output_tokens", "swaps")


# ---- JSON ------------------------------------------------------------------------------------------------

@query("""SELECT event_id, CASE WHEN event_type <> 'purchase' THEN CAST(json_extract_string(props, '$.k') AS INTEGER)
  END AS k FROM events""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in five shapes, read back: plain, labelled fence, inline, bare fence, none."""
    kind, p = F.col("event_type"), F.col("props")
    raw = (F.when(kind == "click", F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nBye {x}")))
           .when(kind == "error", F.concat(F.lit("Sure! "), p, F.lit(" there you go")))
           .when(kind == "signup", F.concat(F.lit("```\n"), p, F.lit("\n```")))
           .when(kind == "purchase", F.lit("no object here")).otherwise(p))
    from pyspark.sql import types as T
    return corpus.table(spark, sf_dir, "events").select(
        "event_id", text.reply(raw, _st(k=T.IntegerType())).getField("k").alias("k"))


@query("""SELECT s_suppkey, '{"name":"' || s_name || '","score":{"nation":' || s_nationkey || '},"tags":["a","' ||
  s_suppkey || '"]}' AS body FROM supplier""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation"))
                    .alias("score"), F.array(F.lit("a"), F.col("s_suppkey").cast("string"))
                    .alias("tags"))
    return corpus.table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(tree).alias("body"))


# ---- manifests ----------------------------------------------------------------------------------------------

PYPROJECT = '''[project]
name = "py@k"
description = "Nation @n"
requires-python = ">=3.@n"
dependencies = ["click>=8.1", "Dep@k[extra]~=1.0; python_version > '3'"]

[project.scripts]
run@k = "pkg@k:main"
'''
PACKAGE_JSON = ('{"name": "js@k", "description": "Node @n", "engines": {"node": ">=@n"}, "dependencies": '
                '{"left": "^1.0", "right@k": "2"}, "scripts": {"test": "t", "build": "b@k", "other": "x", '
                '"start": "s"}, "bin": "cli@k.js"}')
WORKSPACE = '{"name": "ws@k", "workspaces": ["packages/*"], "bin": {"go@k": "go.js"}}'
MEMBERS = ('{"dependencies": {"one": "1"}}', '{"dependencies": {"m@k": "1", "n": "2"}}',
           '{"dependencies": {"late": "1", "too": "2"}}')
REQUIREMENTS = "# pinned\nfoo==1.@n\n\n-r more.txt\n  Bar@k>2  \n"
README = ("# Repo @k\n\nRun `pip install plain@k` first.\n\n```bash\n$ pip install repo@k\npip install repo@k\n"
          "uv add repo@k\n```\n\n```python\nimport repo@k\nprint(repo@k.run())\n```\n")


def supplier_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as repositories with packaging files, by nation: all have a README."""
    s = corpus.table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey")
    node, workspace, py = nation < 8, (nation >= 8) & (nation < 12), nation % 2 == 0
    always = F.lit(True)
    planned = [("pyproject.toml", PYPROJECT, py), ("package.json", PACKAGE_JSON, node),
               ("package.json", WORKSPACE, workspace),
               *[(f"packages/{c}/package.json", m, workspace) for c, m in zip("abc", MEMBERS)],
               ("requirements.txt", REQUIREMENTS, nation >= 16), ("README.md", README, always),
               ("pkg/__main__.py", "x = 1\n", nation < 5),
               ("pkg/tool.py", 'if __name__ == "__main__":\n    run()\n', always),
               ("tests/test_a.py", "pass\n", nation > 20)]
    files = F.array_compact(F.array(*[F.when(cond, F.struct(
        F.lit(p).alias("path"), F.lit(body).alias("body"))) for p, body, cond in planned]))
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("repo"),
                    F.col("s_suppkey").cast("string").alias("k"), nation.cast("string").alias("n"),
                    F.explode(files).alias("f")).select(
        "repo", "f.path", F.replace(F.replace(F.col("f.body"), F.lit("@k"), F.col("k")),
                                    F.lit("@n"), F.col("n")).cast("binary").alias("content"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT 's' || k AS repo,
  CASE WHEN n % 2 = 0 THEN 'py' || k WHEN n < 8 THEN 'js' || k WHEN n < 12 THEN 'ws' || k ELSE 's' || k END AS name,
  CASE WHEN n % 2 = 0 THEN 'Nation ' || n WHEN n < 8 THEN 'Node ' || n ELSE '' END AS summary,
  CASE WHEN n % 2 = 0 THEN '>=3.' || n ELSE '' END AS python_requires,
  CASE WHEN n < 8 THEN 'Node >=' || n ELSE '' END AS runtime_requires,
  CASE WHEN n < 8 THEN 'start=s|build=b' || k || '|test=t' ELSE '' END AS run_scripts,
  CASE WHEN n < 8 THEN 'left@^1.0|right' || k || '@2' WHEN n < 12 THEN 'm' || k || '@1|n@2'
       WHEN n % 2 = 0 THEN 'click>=8.1|Dep' || k || '[extra]~=1.0; python_version > ''3'''
       WHEN n >= 16 THEN 'foo==1.' || n || '|Bar' || k || '>2' ELSE '' END AS dependencies,
  CASE WHEN n < 8 THEN 'package.json' WHEN n < 12 THEN 'packages/b/package.json' WHEN n % 2 = 0 THEN 'pyproject.toml'
       WHEN n >= 16 THEN 'requirements.txt' ELSE '' END AS dep_source,
  CASE WHEN n < 12 OR n % 2 = 0 OR n >= 16 THEN 2 ELSE 0 END AS total_deps,
  concat_ws('|', CASE WHEN n % 2 = 0 THEN 'run' || k || '=pkg' || k || ':main' END,
    CASE WHEN n < 8 THEN CASE WHEN n % 2 = 0 THEN 'py' ELSE 'js' END || k || '=cli' || k || '.js' WHEN n < 12 THEN 'go' || k || '=go.js' END) AS console_scripts,
  'pip install repo' || k || '|uv add repo' || k AS install_cmds, 'python' AS usage_lang,
  'import repo' || k || chr(10) || 'print(repo' || k || '.run())' AS usage_block, 'README.md' AS readme,
  CASE WHEN n < 5 THEN 'pkg/__main__.py|' ELSE '' END || 'pkg/tool.py' AS runnable_modules, n > 20 AS has_tests,
  CASE WHEN n >= 8 AND n < 12 THEN 'Several packages in one tree; the dependencies are those of packages/b/package.json, which has most.'
       ELSE '' END AS workspace_note, n < 12 AS is_node
FROM s""")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = supplier_trees(spark, sf_dir)
    m = manifests.read_manifest(files, code_tree.source_files(files))
    pairs = lambda c: F.array_join(F.transform(
        c, lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias(c)
    return m.select("repo", "name", "summary", "python_requires", "runtime_requires",
                    pairs("run_scripts"), F.array_join("dependencies", "|").alias("dependencies"),
                    "dep_source", "total_deps", pairs("console_scripts"),
                    F.array_join("install_cmds", "|").alias("install_cmds"), "usage_lang",
                    "usage_block", "readme",
                    F.array_join("runnable_modules", "|").alias("runnable_modules"), "has_tests",
                    "workspace_note", "is_node")


@query("""SELECT 's' || s_suppkey AS repo, unnest([
  CASE WHEN s_nationkey < 12 THEN CASE WHEN s_nationkey < 8 THEN 'left@^1.0' ELSE 'm' || s_suppkey || '@1' END
       WHEN s_nationkey % 2 = 0 THEN 'click' ELSE 'foo' END,
  CASE WHEN s_nationkey < 12 THEN CASE WHEN s_nationkey < 8 THEN 'right' || s_suppkey || '@2' ELSE 'n@2' END
       WHEN s_nationkey % 2 = 0 THEN 'dep' || s_suppkey ELSE 'bar' || s_suppkey END]) AS dependency
FROM supplier WHERE s_nationkey < 12 OR s_nationkey % 2 = 0 OR s_nationkey >= 16""")
def dependency_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests.read_manifest(supplier_trees(spark, sf_dir))
    return m.select("repo", F.explode("dependencies").alias("spec")).select(
        "repo", text.dependency_name("spec").alias("dependency"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 3 = 0 AS silent FROM supplier)
SELECT 's' || k AS repo, CASE WHEN NOT silent THEN 'pip install repo' || k || chr(10) || 'uv add repo' || k WHEN n < 12 THEN 'npm install'
    WHEN n % 2 = 1 AND n >= 16 THEN 'pip install -r requirements.txt' WHEN n % 2 = 0 THEN 'pip install py' || k ELSE 'pip install s' || k END AS command,
  NOT silent AS quoted, CASE WHEN NOT silent THEN 'As README.md has it' ELSE 'A guess from ' || CASE WHEN n < 12 THEN 'package.json'
    WHEN n % 2 = 1 AND n >= 16 THEN 'requirements.txt' ELSE 'the name of the project' END || ', since README.md has no command' END AS told
FROM s""")
def install_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each supplier's repository is installed, quoted or guessed; every third README gives no command."""
    silent = (F.col("path") == "README.md") & (F.substring("repo", 2, 20).cast("long") % 3 == 0)
    files = supplier_trees(spark, sf_dir).withColumn("content", F.when(silent, F.lit("# About\n").cast("binary"))
                                                     .otherwise(F.col("content")))
    return manifests.read_manifest(files).select("repo", render.install_way().alias("w")).select("repo", "w.*")


# ---- substitutes for dependencies -------------------------------------------------------------------------------

def vector_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as packages: every package requires the next one, one label is abandoned."""
    nxt = F.concat(F.lit("pkg"), (F.col("vec_id") + 1).cast("string"))
    return corpus.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("Pkg"), F.col("vec_id").cast("string")).alias("name"),
        F.when(F.col("label") == 3, "Deprecated, do not use").when(F.col("label") == 4, "")
        .otherwise(F.concat(F.lit("Does job "), F.col("label").cast("string"))).alias("summary"),
        F.when(F.col("label") % 2 == 0, "MIT").alias("license"),
        F.concat(F.lit("https://packages.example/"), F.col("vec_id").cast("string")).alias("home"),
        F.array(nxt).alias("requires"), "embedding",
        F.when(F.col("label") == 5, fixed.PACKAGE_VERSION - 1).otherwise(fixed.PACKAGE_VERSION)
        .alias("_v"))


@query("""WITH pkg AS (SELECT 'pkg' || vec_id AS name, CASE label WHEN 3 THEN 'Deprecated, do not use' WHEN 4 THEN ''
    ELSE 'Does job ' || label END AS summary, 'pkg' || (vec_id + 1) AS requires, embedding::DOUBLE[] AS v
  FROM embeddings WHERE label <> 5),
prop AS (SELECT vec_id, 'pkg' || vec_id AS dependency, unnest(['pkg' || (vec_id + 7), 'pkg' || (vec_id - 1), 'nope' || vec_id])
    AS candidate, unnest([0, 1, 2]) AS ord FROM embeddings)
SELECT 'r' || vec_id AS repo, dependency, candidate, CASE
  WHEN c.name IS NULL THEN 'no such package'
  WHEN c.requires = dependency THEN 'needs ' || dependency || ' itself'
  WHEN c.summary LIKE 'Deprecated%' THEN 'given up by its authors'
  WHEN c.summary <> '' AND d.summary <> '' AND round(list_dot_product(c.v, d.v), 3) < 0.33
    THEN 'another purpose, similarity ' || printf('%.2f', round(list_dot_product(c.v, d.v), 3)) END AS rejected
FROM prop LEFT JOIN pkg c ON c.name = candidate LEFT JOIN pkg d ON d.name = dependency""")
def alternatives_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "embeddings").select("vec_id")
    repo = F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("repo")
    name = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    own = name("Pkg", F.col("vec_id"))
    deps = e.select(repo, F.lit(0).alias("ord"), F.concat(own, F.lit(" >=2.0")).alias("spec"))
    proposed = F.array(F.concat(name("pkg", F.col("vec_id") + 7), F.lit("==1")),
                       name("PKG", F.col("vec_id") - 1), name("nope", F.col("vec_id")), own)
    proposals = e.select(repo, own.alias("dependency"), F.posexplode(proposed)
                         .alias("ord", "candidate"))
    return dependencies.judge_alternatives(deps, proposals, vector_packages(spark, sf_dir)) \
        .select("repo", "dependency", "candidate", "rejected")


@query("""WITH pkg AS (SELECT 'pkg' || vec_id AS name, CASE label WHEN 3 THEN 'Deprecated, do not use' WHEN 4 THEN ''
    ELSE 'Does job ' || label END AS summary, 'pkg' || (vec_id + 1) AS requires, CASE WHEN label % 2 = 0 THEN 'MIT' END AS license,
    'https://packages.example/' || vec_id AS home, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 5),
prop AS (SELECT vec_id, unnest(['pkg' || (vec_id + 7), 'pkg' || (vec_id - 1), 'nope' || vec_id]) AS candidate
    FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 10 = 0),
met AS (SELECT vec_id, candidate, c.license, c.home, 'pkg' || vec_id AS dependency, c.name IS NULL AS absent,
    c.requires = 'pkg' || vec_id AS builds, c.summary LIKE 'Deprecated%' AS dead,
    CASE WHEN c.summary <> '' AND d.summary <> '' THEN round(list_dot_product(c.v, d.v), 3) END AS near
  FROM prop LEFT JOIN pkg c ON c.name = candidate LEFT JOIN pkg d ON d.name = 'pkg' || vec_id),
told AS (SELECT *, CASE WHEN candidate IS NULL THEN NULL WHEN absent THEN 'no such package' WHEN builds THEN 'needs ' || dependency || ' itself'
    WHEN dead THEN 'given up by its authors' WHEN near < 0.33 THEN 'another purpose, similarity ' || printf('%.2f', near) END AS rejected
  FROM met)
SELECT 'r' || vec_id AS repo, dependency, 'the job of ' || dependency AS does, candidate, license, home, rejected,
  CASE WHEN candidate IS NOT NULL THEN CASE WHEN rejected IS NULL THEN coalesce(near, 0.0) ELSE 0.0 END END AS relevance FROM told""")
def proposed_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutes proposed by replies in JSON, checked, with what a document says about them."""
    class Proposer(FactCompleter):
        def _alternatives(self) -> Column:
            number = lambda n: F.substring(n, 4, 20).cast("long")
            name = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
            return F.to_json(F.struct(F.transform("names", lambda n: F.struct(
                n.alias("dependency"), F.concat(F.lit("the job of "), n).alias("does"),
                F.when(number(n) % 10 != 0, F.array(
                    F.concat(name("pkg", number(n) + 7), F.lit("==1")), name("PKG", number(n) - 1), name("nope", number(n))))
                .alias("substitutes"))).alias("alternatives")))

    deps = corpus.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("repo"), F.lit(0).alias("ord"),
        F.concat(F.lit("Pkg"), F.col("vec_id").cast("string"), F.lit(" >=2.0")).alias("spec"))
    return dependencies.find_alternatives(deps, vector_packages(spark, sf_dir), Proposer()).select(
        "repo", "dependency", "does", "candidate", "license", "home", "rejected", "relevance")


@query("SELECT 'Pkg' || vec_id AS name FROM embeddings WHERE label <> 5")
def cache_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.current_packages(vector_packages(spark, sf_dir)).select("name")
