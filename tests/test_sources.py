"""Scans, sinks and small helpers (SC1-SC5, SK2, AG9)."""

import pytest
from pyspark.sql import functions as F

from corvid.operators import quality
from corvid.sources import (latest_partition, latest_snapshot, load_value_from_path, read_csv_strings, read_parquet,
                            read_table, refresh_table, spread_for_cpu, write_csv, write_parquet)


def test_csv_all_strings(spark, tmp_path):
    p = tmp_path / "extract"
    p.mkdir()
    (p / "part.csv").write_text("a,b\n1,x\n2,\n")
    df = read_csv_strings(spark, str(p))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string"]
    assert [tuple(r) for r in df.collect()] == [("1", "x"), ("2", None)]
    df2 = read_csv_strings(spark, str(p), columns=["a", "b"])
    assert df2.count() == 2


def test_table_scan_refresh_and_fallback(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert read_table(spark, "no_such_table_xyz", fallback_path=path).count() == 3
    read_parquet(spark, path).createOrReplaceTempView("corvid_tmp_view")
    refresh_table(spark, "corvid_tmp_view")
    assert read_table(spark, "corvid_tmp_view").count() == 3


def test_refresh_shows_files_added_behind_the_catalog(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    spark.sql(f"CREATE TABLE corvid_refresh_test USING parquet LOCATION '{path}'")
    try:
        assert read_table(spark, "corvid_refresh_test").count() == 3
        pq.write_table(pa.table({"id": [7, 8]}), f"{path}/part-added.parquet")
        assert read_table(spark, "corvid_refresh_test").count() == 3
        refresh_table(spark, "corvid_refresh_test")
        assert read_table(spark, "corvid_refresh_test").count() == 5
    finally:
        spark.sql("DROP TABLE corvid_refresh_test")


def test_csv_files_read_back_unchanged(spark, tmp_path):
    rows = [("1", None, ""), ("2", ' "q", x ', "a\nb"), ("3", "", None), ("4", '""', ",\n,"), ("5", "back\\slash", " ")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    write_csv(df.repartition(2), str(tmp_path / "c"))
    for columns in (["a", "b", "c"], None):
        got = read_csv_strings(spark, str(tmp_path / "c"), columns, multi_line=True)
        assert sorted(map(tuple, got.collect())) == rows


def test_latest_partition_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "loads")
    days = ["20201001", "20201110", "20200930", None]
    write_parquet(spark.range(40).withColumn("load_date", F.element_at(F.array(*[F.lit(x) for x in days]), (F.col("id") % 4 + 1).cast("int"))), path, ["load_date"])
    got = latest_partition(spark, path, "load_date")
    assert sorted((r["id"], str(r["load_date"])) for r in got.collect()) == [(k, "20201110") for k in range(1, 40, 4)]
    assert all("load_date=20201110" in f for f in got.inputFiles())
    with pytest.raises(ValueError):
        latest_partition(spark, path, "other")


def test_latest_snapshot_from_folders(spark, tmp_path):
    base = tmp_path / "loads"
    for day, n in (("20201001", 2), ("20201110", 3)):
        spark.range(n).write.parquet(str(base / day))
    df = spark.read.option("recursiveFileLookup", "true").parquet(str(base))
    df = load_value_from_path(df, r"/(\d{8})/", "load_date")
    out = latest_snapshot(df, "load_date")
    assert out.count() == 3 and {r.load_date for r in out.collect()} == {"20201110"}


def test_parquet_sink_rejects_duplicate_names(spark, tmp_path):
    df = spark.range(2).select("id", F.col("id").alias("x"))
    write_parquet(df, str(tmp_path / "ok"))
    assert read_parquet(spark, str(tmp_path / "ok")).count() == 2
    dup = spark.range(1).selectExpr("id", "id")
    with pytest.raises(ValueError):
        write_parquet(dup, str(tmp_path / "dup"))


def test_observed_count_needs_no_extra_job(spark):
    df, obs = quality.counted(spark.range(10).filter("id % 2 = 0"), "evens")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 5


def test_spread_by_splits_that_hold_rows(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 100, numPartitions=1)
    many = spark.range(0, 100_000, numPartitions=8 * cores)
    assert spread_for_cpu(one).rdd.getNumPartitions() == 2 * cores
    assert spread_for_cpu(many).rdd.getNumPartitions() == 8 * cores
    # One row group in one file that is planned as several splits: all rows are in one of them.
    spark.range(400_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = read_parquet(spark, str(tmp_path / "one"))
        assert scan.rdd.getNumPartitions() > 1 and scan.select(F.spark_partition_id()).distinct().count() == 1
        dealt = spread_for_cpu(scan.limit(10**9) if scan.rdd.getNumPartitions() > 2 * cores else scan)
        assert dealt.select(F.spark_partition_id()).distinct().count() > cores
        # Enough row groups: no exchange.
        spark.range(100_000).repartition(2 * cores).write.parquet(str(tmp_path / "many"))
        assert "Exchange" not in spread_for_cpu(read_parquet(spark, str(tmp_path / "many")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.id for r in spread_for_cpu(one).collect()) == list(range(100))


def test_one_row_group_is_dealt_out_however_many_splits_are_planned(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(400_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = read_parquet(spark, str(tmp_path / "one"))
        planned = scan.rdd.getNumPartitions()
        assert planned > 2 * cores and scan.select(F.spark_partition_id()).distinct().count() == 1
        dealt = spread_for_cpu(scan)
        assert dealt.rdd.getNumPartitions() == planned
        assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 2 * 400_000 / planned
        assert dealt.agg(F.count("id"), F.sum("id")).first() == (400_000, 400_000 * 399_999 // 2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_month_of_most_rows_is_written_by_several_tasks(spark, tmp_path):
    from corvid.plans.q_sources import latest_partition_q
    day = F.when(F.col("id") < 10, F.lit("2023-12-31 10:00:00")).otherwise(F.lit("2024-01-05 11:00:00"))
    (spark.range(30_000).select(F.col("id").alias("event_id"), day.cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.sha2(F.col("id").cast("string"), 256).alias("event_type"))
     .repartition(8).write.parquet(str(tmp_path / "events.parquet")))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        out = latest_partition_q(spark, str(tmp_path))
        assert out.count() == 29_990 and out.select("load_date").distinct().first()[0] == "202401"
        assert out.select(F.input_file_name()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
