"""Query of the language-model operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm import katz


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {f.__name__: f for f in (op2_katz_backoff,)}
ORACLE: dict[str, str] = {}
