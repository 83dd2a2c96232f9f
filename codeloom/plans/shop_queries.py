"""Queries over the shop: source text made from customers, orders and suppliers, then parsed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph, claims, examples, ranking, reviews, symbols
from ..session import as_table, cut_lineage, ensure_checkpoint_dir, ordinal
from ..sources.map_store import MapStore
from ..streaming.arrivals import analyze_arrivals
from . import corpus
from .registry import query

# What the parser must find, written down from the templates, one row per definition.
SHOP = """
cust AS (SELECT 'c' || c_custkey AS repo, c_mktsegment AS seg FROM customer),
ord AS (SELECT 'c' || o_custkey AS repo, o_orderkey AS k, lower(o_orderstatus) AS st,
               o_orderpriority AS pr, 'src/shop/o' || o_orderkey || '.py' AS file,
               'shop.o' || o_orderkey AS m FROM orders),
def AS (
  SELECT repo, 'shop.base.Root' AS qualname, 'Root' AS name, 'class' AS kind, 'src/shop/base.py' AS file,
         1 AS start_line, 5 AS end_line, 'Root of ' || seg || '.' AS docstring, NULL AS owner_class,
         '' AS bases, '' AS params, '' AS calls FROM cust
  UNION ALL SELECT repo, 'shop.base.Root.audit', 'audit', 'method', 'src/shop/base.py', 4, 5, NULL,
         'shop.base.Root', '', 'level', 'normalize' FROM cust
  UNION ALL SELECT repo, 'shop.base.Base', 'Base', 'class', 'src/shop/base.py', 8, 10, NULL, NULL,
         'Root', '', '' FROM cust
  UNION ALL SELECT repo, 'shop.base.Base.shared', 'shared', 'method', 'src/shop/base.py', 9, 10, NULL,
         'shop.base.Base', '', '', 'self.audit' FROM cust
  UNION ALL SELECT repo, 'shop.base.normalize', 'normalize', 'function', 'src/shop/base.py', 13, 14,
         NULL, NULL, '', 'x', 'round_price' FROM cust
  UNION ALL SELECT repo, m || '.Order' || k, 'Order' || k, 'class', file, 4, 12,
         'Order ' || k || ', priority ' || pr || '.', NULL, 'Base', '', '' FROM ord
  UNION ALL SELECT repo, m || '.Order' || k || '.total', 'total', 'method', file, 7, 9, NULL,
         m || '.Order' || k, '', 'rate,extra', 'self.shared,self.audit,fetch_rate' FROM ord
  UNION ALL SELECT repo, m || '.Order' || k || '.status_' || st, 'status_' || st, 'method', file, 11, 12,
         NULL, m || '.Order' || k, '', '', 'super().shared,super' FROM ord
  UNION ALL SELECT repo, m || '.place_' || k, 'place_' || k, 'function', file, 15, 21,
         'Uses normalize and round_price.', NULL, '', 'qty,opts',
         'Order' || k || ',items.append,normalize,order.total' FROM ord
)"""
SHOP_EDGE = SHOP + """,
per AS (SELECT repo, count(*) AS n, min(m || '.Order' || k || '.total') AS one FROM ord GROUP BY repo),
edge AS (
  SELECT repo, 'shop.base.Root.audit' AS caller, 'shop.base.normalize' AS callee FROM cust
  UNION ALL SELECT repo, 'shop.base.Base.shared', 'shop.base.Root.audit' FROM cust
  UNION ALL SELECT repo, m || '.Order' || k || '.total', 'shop.base.Base.shared' FROM ord
  UNION ALL SELECT repo, m || '.Order' || k || '.total', 'shop.base.Root.audit' FROM ord
  UNION ALL SELECT repo, m || '.Order' || k || '.status_' || st, 'shop.base.Base.shared' FROM ord
  UNION ALL SELECT repo, m || '.place_' || k, m || '.Order' || k FROM ord
  UNION ALL SELECT repo, m || '.place_' || k, 'shop.base.normalize' FROM ord
  UNION ALL SELECT repo, m || '.place_' || k, one FROM ord JOIN per USING (repo) WHERE n = 1
),
open AS (
  SELECT repo, 'shop.base.normalize' AS caller, 'round_price' AS text FROM cust
  UNION ALL SELECT repo, m || '.Order' || k || '.total', 'fetch_rate' FROM ord
  UNION ALL SELECT repo, m || '.place_' || k, 'order.total (ambiguous: ' || n || ')'
    FROM ord JOIN per USING (repo) WHERE n > 1
)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shop_files(spark, sf_dir)


def _defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = as_table(symbols.parse_files(_files(spark, sf_dir)))
    return symbols.unique_symbols(symbols.definitions(parsed))


def _listed(c: str) -> F.Column:
    return F.array_join(c, ",")


@query(f"WITH {SHOP} SELECT * FROM def")
def parse_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defs(spark, sf_dir).select(
        "repo", "qualname", "name", "kind", "file", "start_line", "end_line", "docstring",
        "owner_class", _listed("bases").alias("bases"), _listed("params").alias("params"),
        F.array_join("calls.display", ",").alias("calls"))


TS = """
s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS repo, 'web.s' || s_suppkey AS m, s_name FROM supplier)
SELECT repo, m || '.list_' || k AS qualname, 'function' AS kind, 3 AS start_line, 6 AS end_line,
       'Lists ' || s_name || '.' AS docstring, 'a,b' AS params, true AS exported,
       'trim_' || k || ',pick_' || k AS calls FROM s
UNION ALL SELECT repo, m || '.list_' || k || '.pick_' || k, 'function', 4, 4, NULL, 'row', false,
       'trim_' || k FROM s
UNION ALL SELECT repo, m || '.Store' || k, 'class', 7, 11, NULL, '', true, '' FROM s
UNION ALL SELECT repo, m || '.Store' || k || '.open', 'method', 9, 9, 'Opens it.', 'mode', false,
       'list_' || k FROM s
UNION ALL SELECT repo, m || '.Store' || k || '.close', 'method', 10, 10, NULL, '', false,
       'new Store' || k || '().open,Store' || k FROM s
UNION ALL SELECT repo, m || '.trim_' || k, 'function', 12, 12, NULL, 'row', false, 'row.trim' FROM s"""


@query(f"WITH {TS}")
def parse_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(corpus.supplier_scripts(spark, sf_dir))


def _scripts(files: DataFrame) -> DataFrame:
    return symbols.definitions(symbols.parse_files(files)).select(
        "repo", "qualname", "kind", "start_line", "end_line", "docstring", _listed("params").alias("params"),
        "exported", F.array_join("calls.display", ",").alias("calls"))


TSX = """
s AS (SELECT s_suppkey AS k, 's' || s_suppkey AS repo, 'web.s' || s_suppkey AS m FROM supplier),
f(name, kind, a, b, params, exported, calls) AS (VALUES
  ('run_@', 'function', 1, 1, '', false, 'go_@'), ('load_@', 'function', 2, 4, 'x', false, 'part_@'),
  ('outer_@', 'function', 5, 8, '', false, 'setTimeout,inner_@,memo'),
  ('Page_@', 'function', 9, 11, 'p,q', true, 'b_@,c_@,go_@'), ('Box_@', 'class', 12, 12, '', false, ''),
  ('Box_@.#p', 'method', 12, 12, 'x', false, 'tag_@`a ${x}`.catch,tag_@'))
SELECT repo, m || '.' || replace(name, '@', k::VARCHAR) AS qualname, kind, a AS start_line, b AS end_line,
       NULL::VARCHAR AS docstring, params, exported, replace(calls, '@', k::VARCHAR) AS calls FROM s, f"""


@query(f"WITH {TSX}")
def parse_script_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of results, markup, functions within expressions, private members, tagged templates."""
    return _scripts(corpus.supplier_scripts(spark, sf_dir, corpus.SUPPLIER_TSX, ".tsx"))


@query(f"WITH {SHOP_EDGE} SELECT repo, caller, callee FROM edge")
def self_call_mro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on self and super, followed up the bases, next to plain names."""
    d = as_table(_defs(spark, sf_dir).drop("source", "docstring"))
    return callgraph.call_edges(callgraph.resolve_calls(callgraph.call_sites(d), d)) \
        .select("repo", "caller", "callee")


@query(f"WITH {SHOP_EDGE}, o AS (SELECT repo, count(*) AS u FROM open GROUP BY repo), e AS (SELECT "
       "repo, count(*) AS e FROM edge GROUP BY repo) SELECT repo, CAST(e AS BIGINT) AS edges, CAST(u AS "
       "BIGINT) AS unresolved, round(100.0 * e / (e + u), 6)::DOUBLE AS pct FROM e JOIN o USING (repo)")
def repo_resolve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = callgraph.analyze_files(_files(spark, sf_dir))
    return callgraph.resolution_rate(a.edges, a.unresolved).select(
        "repo", "edges", "unresolved", F.round("pct", 6).alias("pct"))


@query("SELECT 'c' || c_custkey AS repo, n AS name FROM customer, (VALUES ('Base'), ('Root')) t(n)")
def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    none = spark.createDataFrame([], "repo string, name string, exported boolean")
    return symbols.exported_names(files, none)


@query("SELECT DISTINCT 'c' || o_custkey AS repo, 'amount' AS name FROM orders")
def self_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.attributes_of_files(_files(spark, sf_dir))


@query(f"""WITH {SHOP_EDGE},
fan AS (SELECT d.*, (SELECT count(*) FROM edge e WHERE e.repo = d.repo AND e.callee = d.qualname) AS i,
               (SELECT count(*) FROM edge e WHERE e.repo = d.repo AND e.caller = d.qualname) AS o FROM def d),
sc AS (SELECT repo, qualname, round(3.0 * least(i, 5) + 1.5 * least(o, 6)
  + CASE WHEN docstring IS NULL THEN 0 ELSE 2 END + CASE kind WHEN 'class' THEN 1.5 ELSE 0 END
  + CASE WHEN name IN ('Base', 'Root') THEN 9 ELSE 0 END
  + CASE WHEN owner_class IN ('shop.base.Base', 'shop.base.Root') THEN 5 ELSE 0 END
  + least((end_line - start_line + 1) / 25.0, 2), 2)::DOUBLE AS score FROM fan)
SELECT repo, qualname, score, row_number() OVER (PARTITION BY repo ORDER BY score DESC, qualname) AS rank
FROM sc QUALIFY rank <= 5""")
def rank_every_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From source text to the five most important definitions of every repository."""
    a = callgraph.analyze_files(_files(spark, sf_dir))
    return ranking.top_symbols(a.symbols, a.edges, a.exports, 5).select(
        "repo", "qualname", "score", F.col("rank").cast("long").alias("rank"))


# ---- claims -----------------------------------------------------------------------------------

# (type, subject, object, quote, rule, kind, severity) for one order @k; the rule is what
# the checks must decide.
CLAIMS = (
    ("calls", "place_@k", "Order@k", "place_@k builds an Order@k.", "clean", None, None),
    ("calls", "`place_@k()`", "normalize", "place_@k calls normalize.", "clean", None, None),
    ("calls", "Order@k", "place_@k", "Order@k calls place_@k.", "false-call", "false-call", "error"),
    ("calls", "Order@k", "Order@k.status_x", "Order@k calls status_x.", "outside", "unverifiable",
     "warning"),
    ("calls", "shop.o@k.Order@k.total", "Order@k", "total is a method of Order@k.", "clean", None, None),
    ("calls", "normalize", "audit", "The module formats prices.", "unattributed", "unverifiable",
     "warning"),
    ("calls", "normalize", "audit", "normalize hands over to audit.", "false-call", "false-call",
     "error"),
    ("calls", "place_@k", "shop.base.Base", "place_@k uses Base.", "false-call", "false-call", "error"),
    ("calls", "place_@k", "fetch_rate", "place_@k calls fetch_rate.", "outside", "unverifiable",
     "warning"),
    ("calls", "Order Handling", "normalize", "Order Handling calls normalize.", "unknown-name",
     "unknown-name", "warning"),
    ("location", "place_@k", "src/shop/o@k.py:16", "place_@k is at src/shop/o@k.py:16.", "clean", None,
     None),
    ("location", "place_@k", "o@k.py:3", "place_@k is at o@k.py:3.", "wrong-location",
     "wrong-location", "error"),
    ("location", "place_@k", "o@k.py:999", "It lives in the file of its order.", "clean", None, None),
    ("location", "place_@k", "other/cart.py", "place_@k is a helper. The rest is in other/cart.py now.",
     "unbound", "unverifiable", "warning"),
    ("location", "place_@k", "other/cart.py", "place_@k is in other/cart.py.", "wrong-location",
     "wrong-location", "error"),
    ("location", "place_@k", "the technical documentation", "place_@k is documented.", "ignored", None,
     None),
    ("location", "place_@k", "class", "place_@k is in a class.", "ignored", None, None),
    ("location", "shared", "shop.base.Base", "shared lives on Base.", "clean", None, None),
    ("location", "the whole flow", "o@k.py", "the whole flow is in o@k.py.", "ignored", None, None),
    ("location", "mystery_@k", "o@k.py", "mystery_@k is in o@k.py.", "unknown-name", "unknown-name",
     "warning"),
    ("parameter", "place_@k", "qty", "place_@k takes qty.", "clean", None, None),
    ("parameter", "place_@k", "**opts", "place_@k takes **opts.", "clean", None, None),
    ("parameter", "place_@k", "rate", "place_@k takes rate.", "wrong-parameter", "wrong-parameter",
     "error"),
    ("parameter", "place_@k", "a big number", "place_@k takes a big number.", "ignored", None, None),
    ("parameter", "Order@k", "qty", "Order@k takes qty.", "ignored", None, None),
    ("behaviour", "place_@k", "is fast", "place_@k is fast.", "clean", None, None),
    ("behaviour", "shop/base.py", "does things", "shop/base.py does things.", "ignored", None, None),
)


def shop_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim template about every order."""
    parts = F.array(*[F.struct(
        F.lit(i).alias("ord"), F.lit(c[0]).alias("type"), F.lit(c[1]).alias("subject"),
        F.lit(c[2]).alias("object"), F.lit(c[3]).alias("quote")) for i, c in enumerate(CLAIMS)])
    key = F.col("o_orderkey").cast("string")
    filled = lambda c: F.replace(F.col(c), F.lit("@k"), F.col("key")).alias(
        c.split(".")[1])
    return (corpus.dealt(corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(
                F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo"),
                key.alias("key"), F.explode(parts).alias("c"))
            .select("repo", F.concat_ws("#", "key", F.col("c.ord").cast("string")).alias("claim_id"),
                    F.concat(F.lit("order:"), "key").alias("section_key"), "c.ord", "c.type",
                    filled("c.subject"), filled("c.object"), filled("c.quote")))


def _sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


CLAIM_SQL = "claim(i, rule, kind, severity) AS (VALUES " + ", ".join(
    f"({i}, {_sql_text(c[4])}, {_sql_text(c[5])}, {_sql_text(c[6])})"
    for i, c in enumerate(CLAIMS)) + ")"


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = callgraph.analyze_files(_files(spark, sf_dir))
    edges = cut_lineage(a.edges)
    return claims.judge_claims(shop_claims(spark, sf_dir), a.symbols, edges), a.symbols, edges


@query(f"WITH {CLAIM_SQL} SELECT 'c' || o_custkey AS repo, o_orderkey || '#' || i AS claim_id, rule, "
       "kind, severity FROM orders, claim")
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[0].select("repo", "claim_id", "rule", "kind", "severity")


# What a failed claim is answered with.
FAILED = """
SELECT repo, k || '#2' AS claim_id, 'no call leads from ''Order' || k || ''' to ''place_' || k ||
  '''. It calls nothing here.' AS detail FROM ord
UNION ALL SELECT repo, k || '#6', 'no call leads from ''normalize'' to ''audit''. It calls nothing here.' FROM ord
UNION ALL SELECT repo, k || '#7', 'no call leads from ''place_' || k || ''' to ''shop.base.Base''. What it '
  || 'calls: ''Order' || k || ''', ''normalize''' || CASE WHEN n = 1 THEN ', ''total''' ELSE '' END || '.'
  FROM ord JOIN per USING (repo)
UNION ALL SELECT repo, k || '#22', 'place_' || k || '() takes opts, qty, but no ''rate''. That belongs to total.'
  FROM ord
UNION ALL SELECT repo, k || '#11', '''place_' || k || ''' stands in ' || file || ':15, not in ''o' || k || '.py:3'''
  FROM ord
UNION ALL SELECT repo, k || '#14', '''place_' || k || ''' stands in ' || file || ':15, not in ''other/cart.py'''
  FROM ord"""


@query(f"WITH {SHOP_EDGE} {FAILED}")
def failed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, sym, edges = _judged(spark, sf_dir)
    return claims.explained(cut_lineage(judged), sym, edges).where("severity = 'error'") \
        .select("repo", "claim_id", "detail")


@query(f"""WITH {CLAIM_SQL} SELECT 'c' || o_custkey AS repo, 'order:' || o_orderkey AS key,
  count(*) AS claims_checked, count(*) FILTER (severity = 'error') AS errors,
  count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS passed
FROM orders, claim GROUP BY o_custkey, o_orderkey""")
def review_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per section, all sections of all repositories in one plan."""
    judged = cut_lineage(_judged(spark, sf_dir)[0])
    made = shop_claims(spark, sf_dir)
    sections = made.select("repo", F.col("section_key").alias("key"),
                           F.col("section_key").alias("heading"), F.lit(0).alias("ord")).distinct()
    issues = judged.where("kind is not null").select(
        "repo", F.col("section_key").alias("key"), "severity")
    return reviews.review_sections(sections, issues, made).select(
        "repo", "key", "claims_checked", "errors", "warnings", "passed")


@query(f"""WITH {CLAIM_SQL}, w AS (SELECT 'c' || o_custkey AS repo, o_orderkey, i,
  CASE i WHEN 5 THEN 'the quoted words name neither ''normalize'' nor ''audit''; their call is not theirs to claim'
         WHEN 9 THEN 'nothing defined here is called ''Order Handling'''
         ELSE i || ' ' || o_orderkey END AS detail
  FROM orders, claim WHERE severity = 'warning'),
o AS (SELECT repo, detail, min((o_orderkey, i)) AS "at" FROM w GROUP BY repo, detail)
SELECT repo, rank, total, common FROM (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY "at") AS rank,
  count(*) OVER (PARTITION BY repo) AS total, detail LIKE '%Order Handling%' OR detail LIKE '%name neither%' AS common
  FROM o) WHERE rank <= 8""")
def first_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings once each, first seen first, eight per repository and the number of all."""
    judged = cut_lineage(_judged(spark, sf_dir)[0])
    at = ordinal(F.substring_index("claim_id", "#", 1).cast("long").alias("k"), "ord")
    issues = judged.withColumn("ord", at)
    top = reviews.first_warnings(issues)
    return top.select("repo", F.col("rank").cast("long").alias("rank"), "total",
                      (F.col("detail").contains("Order Handling")
                       | F.col("detail").contains("name neither")).alias("common"))


@query(f"""WITH {SHOP}
SELECT repo, name FROM (
  SELECT repo, name FROM def UNION SELECT repo, qualname FROM def
  UNION SELECT repo, unnest(string_split(params, ',')) FROM def WHERE params <> ''
  UNION SELECT repo, 'amount' FROM ord UNION SELECT repo, unnest(['src', 'shop', 'base.py', 'base', repo]) FROM cust
  UNION SELECT repo, unnest(['o' || k || '.py', 'o' || k]) FROM ord)""")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = as_table(symbols.parse_names(_files(spark, sf_dir)))
    sym = symbols.unique_symbols(symbols.definitions(parsed))
    return reviews.known_names(sym, symbols.attribute_names(parsed))


# ---- examples ------------------------------------------------------------------------------------

def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test per order of a customer: it calls, or only mentions, what its order defines."""
    key = F.col("o_orderkey").cast("string")
    direct = F.col("o_orderstatus") == "O"
    body = F.concat(F.lit("def test_"), key, F.lit("():\n    "), F.when(direct, F.concat(
        F.lit("assert place_order("), key, F.lit(")"))).otherwise("check(place_order)"))
    return corpus.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("repo"),
        F.concat(F.lit("test_"), key).alias("name"),
        F.concat(F.lit("tests.t.test_"), key).alias("qualname"), F.lit("function").alias("kind"),
        F.lit("tests/t.py").alias("file"), F.lit(1).alias("start_line"),
        F.length("o_orderpriority").alias("line_count"), body.alias("source"))


@query("""SELECT repo, 'place_order' AS uses, rank, name FROM (
  SELECT 'c' || o_custkey AS repo, 'test_' || o_orderkey AS name, row_number() OVER (PARTITION BY
    o_custkey ORDER BY o_orderstatus <> 'O', length(o_orderpriority), 'tests.t.test_' || o_orderkey) AS rank
  FROM orders) WHERE rank <= 2""")
def example_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = corpus.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("repo"),
        F.lit("shop.place_order").alias("name"))
    return examples.find_examples(wanted, _tests(spark, sf_dir)).select(
        "repo", "uses", F.col("rank").cast("long").alias("rank"), "name")


@query("SELECT 'c' || c_custkey AS repo, unnest(['Root', 'Base']) AS name, unnest(['class Root:', "
       "'class Base(Root):']) AS head FROM customer UNION ALL SELECT 'c' || o_custkey, 'Order' || "
       "o_orderkey, 'class Order' || o_orderkey || '(Base):' FROM orders")
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a class is embedded as: its header."""
    from ..operators.retrieval import class_summary as head
    return _defs(spark, sf_dir).where("kind = 'class'").select("repo", "name", head().alias("head"))


# ---- kept analysis ---------------------------------------------------------------------------

def _two_arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The shop as it arrives: first with other text in a third of the order files and some that go again."""
    files = _files(spark, sf_dir)
    key = F.regexp_extract("path", r"o(\d+)[.]py$", 1)
    number = key.try_cast("long")  # null for the files that are of no order
    third = number % 3 == 0
    body = F.col("content").cast("string")
    earlier = F.concat(F.replace(body, F.lit("items.append(normalize(qty))"), F.lit("items.append(audit(qty))")),
                       F.lit("\n\ndef normalize(x):\n    return list_all(x)\n"))
    first = files.withColumn("content", F.when(third, earlier.cast("binary")).otherwise(F.col("content")))
    going = files.where(number % 5 == 0).select(
        "repo", F.concat(F.lit("src/shop/extra"), key, F.lit(".py")).alias("path"),
        F.concat(F.lit("from .base import Root\n\n\nclass Root(Base):\n    def audit(self):\n        return place_"), key,
                 F.lit("()\n")).cast("binary").alias("content"))
    made = lambda n: F.timestamp_seconds(F.lit(n)).alias("made")
    return (first.unionByName(going).select("*", made(1)),
            files.where(third).unionByName(going.withColumn("content", F.lit(None).cast("binary"))).select("*", made(2)))


def _taken(spark: SparkSession, sf_dir: str) -> MapStore:
    """A store that took both arrivals from a stream, one after the other."""
    folder = f"{ensure_checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    for arrival in _two_arrivals(spark, sf_dir):
        arrival.write.mode("append").parquet(f"{folder}/inbox")
        analyze_arrivals(spark, f"{folder}/inbox", f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return MapStore(spark, f"{folder}/store")


@query(f"WITH {SHOP_EDGE} SELECT repo, caller, callee FROM edge")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges kept up to date over two arrivals are those of the files as they ended."""
    return _taken(spark, sf_dir).analysis().edges.select("repo", "caller", "callee")


@query(f"""WITH {SHOP_EDGE}, e AS (SELECT DISTINCT repo, caller, callee FROM edge)
SELECT repo, qualname, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out
FROM (SELECT repo, caller AS qualname, 0 AS i, 1 AS o FROM e UNION ALL SELECT repo, callee, 1, 0 FROM e)
GROUP BY repo, qualname""")
def incremental_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan counts moved by what each arrival retracts and adds."""
    return _taken(spark, sf_dir).fan().select("repo", "qualname", "fan_in", "fan_out")


@query("""SELECT 'c' || o_custkey AS repo, 'src/shop/o' || o_orderkey || '.py' AS file FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'c' || o_custkey, 'src/shop/extra' || o_orderkey || '.py' FROM orders WHERE o_orderkey % 5 = 0""")
def stale_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose kept analysis is not that of their content now: changed since, or gone."""
    store = MapStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.update(_two_arrivals(spark, sf_dir)[0].drop("made"))
    return store.stale(_files(spark, sf_dir))
