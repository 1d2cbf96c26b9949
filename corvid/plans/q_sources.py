"""Source queries with their SQL oracles.  Files that a query reads back are written to the shared folder from given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvid.plans import bindings as b
from corvid.plans.catalog import register
from corvid.session import scratch_path
from corvid.sources import latest_partition, read_csv_strings, read_table, refresh_table, write_csv, write_parquet


@register("catalog_scan", "SELECT n_regionkey, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY n_regionkey")
def catalog_scan(spark, d):
    """SC2 + SC3: a catalog table is read, its files are replaced by the whole given table, and the refresh shows them."""
    nation, path, name = b.table(spark, d, "nation"), scratch_path(spark, "catalog"), f"corvid_nation_{uuid.uuid4().hex}"
    write_parquet(nation.where("n_regionkey < 2"), path)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    read_table(spark, name).count()
    write_parquet(nation, path)
    refresh_table(spark, name)
    out = read_table(spark, name).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))
    spark.sql(f"DROP TABLE {name}")   # the files stay for the result
    return out


_NOTE = """CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '"' || s_name || '", ' || chr(10) || 'second "line"'
  WHEN 3 THEN ' ' || s_name || ', ' ELSE s_name END"""


@register("csv_strings", f"SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey, {_NOTE} AS note FROM supplier")
def csv_strings(spark, d):
    """SC5: a given table as CSV files with quotes, line feeds, blanks, empty and NULL values, read back with every column a string."""
    path = scratch_path(spark, "csv")
    write_csv(b.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.expr(_NOTE).alias("note")), path)
    return read_csv_strings(spark, path, ["s_suppkey", "s_name", "s_nationkey", "note"], multi_line=True)


@register("latest_partition", """
SELECT event_id, user_id, event_type, strftime(ts, '%Y%m') AS load_date FROM events
WHERE strftime(ts, '%Y%m') = (SELECT max(strftime(ts, '%Y%m')) FROM events)""")
def latest_partition_q(spark, d):
    """SC4: events in one folder per month, of which only the newest is read."""
    path = scratch_path(spark, "loads")
    events = b.table(spark, d, "events").withColumn("load_date", F.date_format("ts", "yyyyMM"))
    # One month may hold most rows: a folder gets as many files as its rows need, not one task.
    write_parquet(events.hint("rebalance", "load_date"), path, ["load_date"])
    out = latest_partition(spark, path, "load_date")
    return out.select("event_id", "user_id", "event_type", F.col("load_date").cast("string").alias("load_date"))


_SCANNED = ("region", "part", "pages", "customer")


@register("scan_only", " UNION ALL ".join(
    f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns" for t in _SCANNED))
def scan_only(spark, d):
    """SC6: inputs that are scanned and used by nothing else: their rows and columns."""
    out = None
    for t in _SCANNED:
        df = b.table(spark, d, t)
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out
