"""Scans (SC1-SC6).  All readers return lazy DataFrames; projection and
filters applied later are pushed into the Parquet scan by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """SC1: Parquet scan by path (explicit schema when given: no inference)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def read_table(spark: SparkSession, name: str, fallback_path: str | None = None) -> DataFrame:
    """SC2: catalog table scan; a path fallback serves tests with no catalog."""
    if spark.catalog.tableExists(name) or fallback_path is None:
        return spark.table(name)
    return read_parquet(spark, fallback_path)


def refresh_table(spark: SparkSession, name: str) -> None:
    """SC3: drop cached file listings/metadata of a catalog table."""
    spark.catalog.refreshTable(name)


#: Private-use character that stands for a quoted empty field while a CSV file is read.
_EMPTY = "\uE000"


def read_csv_strings(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """SC5: CSV with a header row, every column a string (no inference pass).

    With ``columns`` the schema is declared up front, which avoids the extra
    job Spark runs to read the header.  Quotes inside a quoted value are
    doubled; an empty field is NULL and a quoted empty one is empty.
    ``multi_line`` allows line feeds inside quotes; a file is then read whole
    by one task, so such extracts should come as many files.
    """
    # Spark reads a quoted empty field as its emptyValue, and an emptyValue that equals nullValue as NULL.
    reader = (spark.read.option("header", "true").option("escape", '"').option("multiLine", multi_line)
              .option("emptyValue", _EMPTY))
    if columns:
        reader = reader.schema(StructType.fromJson(
            {"type": "struct", "fields": [
                {"name": n, "type": "string", "nullable": True, "metadata": {}} for n in columns]}))
    df = reader.csv(path)
    return df.select(*[F.when(F.col(f"`{c}`") == _EMPTY, F.lit("")).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def latest_snapshot(df: DataFrame, load_col: str) -> DataFrame:
    """SC4: keep only the rows of the newest load (``max(load_col)``).

    On a table partitioned by ``load_col`` the scalar subquery becomes a
    partition filter at run time; nothing is listed or collected on the
    driver.  Rows whose load value is NULL are never the latest.
    """
    newest = df.agg(F.max(load_col).alias("_newest"))
    return (df.join(newest, F.col(load_col) == F.col("_newest"), "left_semi"))


def latest_partition(spark: SparkSession, path: str, name: str = "load_date") -> DataFrame:
    """SC4: the newest load of a Parquet table in ``name=value`` folders.

    The folder names are listed once and the last one by name is read; no
    file of another load is listed or opened.  A default (NULL) partition is
    never the latest.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    loads = sorted(n for n in (s.getPath().getName() for s in listed if s.isDirectory())
                   if n.startswith(f"{name}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__"))
    if not loads:
        raise ValueError(f"no {name}= folder in {path}")
    return spark.read.option("basePath", path).parquet(f"{path}/{loads[-1]}")


def load_value_from_path(df: DataFrame, pattern: str, name: str = "load_date") -> DataFrame:
    """SC4 helper: derive the load folder name from each row's source file."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


#: Shares of a core that a split may have without being dealt out.
EVEN = 1.5


def spread_for_cpu(df: DataFrame, factor: int = 2) -> DataFrame:
    """Deal a scan out before CPU-heavy per-row work (regexes over whole texts) if it would leave cores idle.

    Spark cuts a file into splits by bytes, but a Parquet row group goes whole
    to the split that holds its middle, so a file of few row groups has rows in
    few splits, however many are planned.  The rows of each split are counted,
    from the file footers only; where one split has more than a core's share,
    the rows are dealt out over ``factor`` partitions per core, or as many as
    Spark planned splits by bytes if these are more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = df.rdd.getNumPartitions()
    rows = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    most, n = rows.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return df.repartition(max(planned, factor * cores)) if most * cores > EVEN * n or planned < cores else df
