"""Plan shape and skew: the per-key operators must not sort a hot key inside
one window task, filters must reach the scans, and results under a key that
holds a third of all rows must equal the plain window formulation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvid.operators import payments as pay
from corvid.operators import quality, spine
from corvid.plans import claims_flow as flow

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _skewed(spark, n=3000):
    # key 0 holds a third of all rows; dates and amounts vary
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("claim_number"),
        (F.col("id") % 5).alias("claimant_number"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(
            F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 37).cast("int"))).alias("payment_date"),
        (F.col("id") % 7).cast("double").alias("payment_amount"),
        F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.lit("s")).alias("data_source"))


def test_flagship_pushes_filters_and_prunes(spark):
    plan = _plan(flow.injury_payments(spark, SF))
    assert "Window" not in plan
    assert "EqualTo(l_returnflag,R)" in plan   # the status filter follows (list is truncated)
    # the latest-date side reads only the key and date columns, and its
    # enrichment joins are eliminated (left joins under a max)
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_shipdate:timestamp_ntz>" in plan
    assert plan.count("FileScan parquet") == 4


def test_latest_flag_skewed_equals_window(spark):
    df = _skewed(spark)
    got = pay.latest_flag(df).groupBy().agg(F.sum("max"), F.count("*")).first()
    w = Window.partitionBy("claim_number", "claimant_number")
    ref = df.withColumn("m", F.when(F.col("payment_date") == F.max("payment_date").over(w), 1).otherwise(0))
    exp = ref.groupBy().agg(F.sum("m"), F.count("*")).first()
    assert tuple(got) == tuple(exp)
    assert "Window" not in _plan(pay.latest_flag(df))


def test_one_row_per_key_skewed_equals_row_number(spark):
    df = _skewed(spark)
    got = sorted(tuple(r) for r in spine.one_row_per_key(df, ["claim_number"]).collect())
    rest = [c for c in df.columns if c != "claim_number"]
    w = Window.partitionBy("claim_number").orderBy(*[F.asc_nulls_first(c) for c in rest])
    exp = sorted(tuple(r) for r in df.withColumn("rn", F.row_number().over(w))
                 .filter("rn = 1").drop("rn").select(*df.columns).collect())
    assert got == exp
    plan = _plan(spine.one_row_per_key(df, ["claim_number"]))
    assert "Window" not in plan and "partial_min" in plan


def test_duplicate_keys_skewed_equals_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("claim_number", "data_source")
    exp = df.withColumn("c", F.count("claim_number").over(w)).filter("c > 1").count()
    got = quality.duplicate_keys(df)
    assert got.count() == exp
    assert "Window" not in _plan(got)


def test_pivot_is_one_aggregate_level(spark):
    plan = _plan(flow.payment_pivot(spark, SF))
    assert "pivotfirst" not in plan
