"""Query of the packing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.packing import pack_sequences

ORACLE: dict[str, str] = {}


def tokenizer_path() -> str:
    """Default vocabulary; the operator takes any path."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
