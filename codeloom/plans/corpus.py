"""Code relations that Spark derives from the given tables, row by row.

Two corpora. The *catalog* is one big repository: a part is a definition, a line
item is a call. The *shop* is real source text, one repository per customer:
each customer and each order becomes a Python file that is then parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt over all cores before each of them becomes a text to work on."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


# ---- catalog --------------------------------------------------------------------------

def _adj() -> Column:
    return F.substring_index("p_name", " ", 1)


def _noun() -> Column:
    return F.substring_index("p_name", " ", -1)


def catalog_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat_ws("_", _adj(), F.floor(F.col("p_partkey") / 3).cast("string"))
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    name = (F.when(F.col("p_size") == 50, F.concat(F.lit("__"), stem, F.lit("__")))
            .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("_"), stem)).otherwise(stem))
    kind = (F.when(F.col("p_type") == "STANDARD", "class")
            .when(F.col("p_type").isin("SMALL", "MEDIUM"), "method").otherwise("function"))
    params = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")) \
              .otherwise(F.array(_noun(), F.lit("qty")))
    head = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("def "), name, F.lit("(a: int):"))) \
            .otherwise(F.concat(F.lit("def "), name, F.lit("(a,")))
    return (table(spark, sf_dir, "part").select(
        F.lit("catalog").alias("repo"), F.array().cast("array<string>").alias("bases"),
        F.concat_ws(".", brand, _noun(), F.concat(F.lit("p"), F.col("p_partkey").cast("string")),
                    name).alias("qualname"),
        name.alias("name"), kind.alias("kind"),
        F.concat(F.lit("src/"), brand, F.lit("/"), _noun(), F.lit(".py")).alias("file"),
        (1 + F.col("p_partkey") % 1000 * 60).cast("int").alias("start_line"),
        (F.col("p_partkey") % 1000 * 60 + F.col("p_size")).cast("int").alias("end_line"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("Makes the "), "p_name", F.lit("."))
               ).alias("docstring"),
        F.concat(head, F.lit("\n    return qty")).alias("source"),
        F.when(kind == "method", F.concat_ws(".", brand, _noun(), stem)).alias("owner_class"),
        params.alias("params"), (F.col("p_type") == "LARGE").alias("exported"),
        "p_partkey", F.col("p_size").alias("line_count"))
        .withColumn("ord", ordinal("file", F.col("p_partkey").alias("pos"))))


def catalog_exports(symbols: DataFrame) -> DataFrame:
    return symbols.where("exported").select("repo", "name").distinct()


def catalog_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites: the part of each line calls a name picked by the order's customer."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    caller = catalog_symbols(spark, sf_dir).select(
        "p_partkey", F.col("qualname").alias("caller"), "owner_class", "file",
        F.regexp_extract("name", "[a-z]+", 0).alias("adj"),
        F.regexp_extract("file", "([a-z]+)[.]py$", 1).alias("noun"))
    simple = F.when(F.col("plain"), "append").otherwise(
        F.concat_ws("_", "adj", F.floor(F.col("o_custkey") / 3).cast("string")))
    called = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("self."), simple)) \
              .when(F.col("l_returnflag") == "A", F.concat_ws(".", "noun", simple)) \
              .otherwise(simple)
    # Equal calls of one part are counted before the part's own columns are joined.
    counted = (line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
               .withColumn("plain", F.col("l_quantity") == 50)
               .withColumn("o_custkey", F.when(F.col("plain"), F.lit(0))
                           .otherwise(F.floor(F.col("o_custkey") / 3) * 3))
               .groupBy("l_partkey", "plain", "l_returnflag", "o_custkey")
               .agg(F.count("*").alias("n"),
                    F.min(ordinal("l_orderkey", "l_linenumber")).alias("at")))
    return (counted.join(caller, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.lit("catalog").alias("repo"), "caller", "owner_class",
                simple.alias("simple"), called.alias("display"), "n",
                ordinal("file", "p_partkey", "at").alias("call_ord"))
            .groupBy("repo", "caller", "owner_class", "simple", "display")
            .agg(F.sum("n").alias("n"), F.min("call_ord").alias("call_ord")))


def catalog_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, p_partkey, simple, at): the calls of catalog_sites one by one, `append` left out, with keys in place of callers.

    Numbers go through the shuffles; a name is put together once its part is there.
    """
    line = (table(spark, sf_dir, "lineitem").where(~F.col("l_quantity").eqNullSafe(50))
            .select("l_orderkey", "l_partkey", "l_linenumber"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_custkey") / 3).alias("number"))
    caller = catalog_symbols(spark, sf_dir).select("p_partkey", F.regexp_extract("name", "[a-z]+", 0).alias("adj"))
    return (line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(caller, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.lit("catalog").alias("repo"), "p_partkey",
                    F.concat_ws("_", "adj", F.col("number").cast("string")).alias("simple"),
                    ordinal("l_orderkey", "l_linenumber").alias("at")))


# ---- shop -----------------------------------------------------------------------------

BASE_PY = '''class Root:
    """Root of @segment."""

    def audit(self, level=1):
        return normalize(level)


class Base(Root):
    def shared(self):
        return self.audit()


def normalize(x):
    return round_price(x)
'''

ORDER_PY = '''import os


class Order@key(Base):
    """Order @key, priority @priority."""

    def total(self, rate, *extra):
        self.amount = rate
        return self.shared() + self.audit() + fetch_rate(rate)

    def status_@status(self):
        return super().shared()


@cache
def place_@key(qty=1, **opts):
    """Uses normalize and round_price."""
    order = Order@key()
    items = []
    items.append(normalize(qty))
    return order.total(qty)
'''

INIT_PY = 'from .base import Base as Base\n__all__ = ["Root"]\n'

SUPPLIER_TS = '''/** Lists @name.
 * @param a first */
export function list_@key(a, b = 2) {
  const pick_@key = (row) => trim_@key(row);
  return pick_@key(a);
}
export class Store@key extends Base {
  /** Opens it. */
  open(mode) { return list_@key(mode) }
  close() { return new Store@key().open(1) }
}
function trim_@key(row) { return row.trim() }
'''


#: Forms that a plain scan of tokens misreads: types of results, markup, functions within expressions.
SUPPLIER_TSX = '''export default class extends Base { run_@key(): { a: 1 } { return go_@key() } }
const load_@key = async <T,>(x: T): Promise<{ a: T }> => {
  return i++ / part_@key(x) / 2
}
function outer_@key(): { a: number } {
  setTimeout(function tick(x) { inner_@key(x) })
  return memo(function Inner(p) { return p })
}
export function Page_@key(p: Map<string, number>, q: string) {
  return <p title="@name's">It's {b_@key()} and it's {c_@key()} <a>http://x.com {go_@key()}</a></p>
}
class Box_@key<A extends { f: () => void }> { #p(x: A): { r: A }[] { return tag_@key`a ${x}`.catch(x) } }
'''


def _filled(template: str, **values: Column | str) -> Column:
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit(f"@{key}"), text.col(value).cast("string"))
    return out


def _file(repo: Column, path: Column | str, body: Column) -> list[Column]:
    path = F.lit(path) if isinstance(path, str) else path
    return [repo.alias("repo"), path.alias("path"), body.cast("binary").alias("content")]


def shop_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    order = dealt(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))
    owner = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    base = customer.select(*_file(owner, "src/shop/base.py",
                                  _filled(BASE_PY, segment="c_mktsegment")))
    init = customer.select(*_file(owner, "src/shop/__init__.py", F.lit(INIT_PY)))
    orders = order.select(*_file(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        F.concat(F.lit("src/shop/o"), F.col("o_orderkey").cast("string"), F.lit(".py")),
        _filled(ORDER_PY, key="o_orderkey", priority="o_orderpriority",
                status=F.lower("o_orderstatus"))))
    return base.unionByName(init).unionByName(orders)


def supplier_scripts(spark: SparkSession, sf_dir: str, template: str = SUPPLIER_TS, ending: str = ".ts") -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return dealt(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")).select(*_file(
        F.concat(F.lit("s"), key), F.concat(F.lit("src/web/s"), key, F.lit(ending)),
        _filled(template, name="s_name", key="s_suppkey")))
