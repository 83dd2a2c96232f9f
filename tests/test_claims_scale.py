"""Claims about code are judged by all cores, in code short enough to be compiled."""

from codeloom.operators import claims
from codeloom.plans import shop_queries

LONGEST = 8000  # bytes of a method, beyond which the JVM leaves it to its interpreter


def longest_method(df) -> int:
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_claims_of_one_small_file_are_made_by_all_cores(spark, tmp_path):
    rows = [(k, k % 7 if k else None, "O") for k in range(40)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").coalesce(1) \
        .write.parquet(f"{tmp_path}/orders.parquet")
    made = shop_queries.shop_claims(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert made.count() == 40 * len(shop_queries.CLAIMS)


def test_names_of_claims_are_read_in_compiled_code(spark):
    made = spark.createDataFrame([("r", "1", "calls", " `f()` ", "m.g", "f calls g."), ("r", "2", "location", "f", "m.py:3", "f"),
                                  ("r", "3", "parameter", "m.f", "qty", "f takes qty."), ("r", "4", "calls", None, "f", "x")],
                                 "repo string, claim_id string, type string, subject string, object string, quote string")
    symbols = spark.createDataFrame([("r", "m.f"), ("r", "m.g"), ("r", "m.py")], "repo string, qualname string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = claims._resolved(made, symbols)
        assert longest_method(out) < LONGEST
        assert {r.claim_id: (r.skey, r.okey, r.ckey) for r in out.collect()} == {
            "1": ("f", "m.g", None), "2": ("f", None, "m.py"), "3": ("m.f", None, None), "4": (None, "f", None)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_names_of_all_claims_are_not_sent_to_the_driver(spark, tmp_path):
    spark.createDataFrame([(k, k % 7) for k in range(40)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    symbols = spark.createDataFrame([("c1", "normalize")], "repo string, qualname string")
    out = claims._resolved(shop_queries.shop_claims(spark, str(tmp_path)), symbols)
    assert "LeftOuter, BuildRight" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("skey is not null").count() == 2 * len([k for k in range(40) if k % 7 == 1])
