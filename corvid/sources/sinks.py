"""Sink (SK2): results stay DataFrames; the one materialising sink is a
Parquet write.  Nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    dupes = {c for c in df.columns if df.columns.count(c) > 1}
    if dupes:  # Q9: a duplicated projection name cannot be written
        raise ValueError(f"duplicate column names {sorted(dupes)}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header that ``read_csv_strings`` reads back unchanged (NULL, empty, quotes, blanks, line feeds)."""
    (df.write.mode(mode).option("header", "true").option("escape", '"').option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
