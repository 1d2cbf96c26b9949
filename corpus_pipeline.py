"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept and returns the rows of ``docs`` that stay, with their
columns; the last returns one row per packed piece.  Rows are told apart by a
row number that holds for every read, so NULL and repeated ids and repeated
rows keep their own decisions; it has a name that no column of ``docs`` has.
A NULL text is empty for every decision and stays NULL; an empty or very long
text is judged whole like any other; an empty table passes through as an
empty table.  Between the steps of a stage only row numbers are written; the
texts are read from the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import toxicity
from corvid.llm.common import ROW, remove, row_keys, scratch, written
from corvid.llm.decontaminate import contaminated
from corvid.llm.naming import exact_groups
from corvid.llm.packing import pack_sequences
from corvid.llm.q_packing import tokenizer_path
from corvid.llm.simhash import simhash_groups


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number, and its name."""
    name = ROW
    while name in docs.columns:
        name += "_"
    return row_keys(docs, name), name


def _only(docs: DataFrame, rows: DataFrame, row: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` in (or not in) ``rows``, whose numbers are written first: Spark then knows whether they are few."""
    return docs.join(written(rows.select(row)), row, how).drop(row)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger predicts toxic go."""
    docs, row = _numbered(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs, model, row_col=row)
    return _only(docs, scored.where("predicted = 1"), row, "left_anti")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (ASCII white space aside) the longest original stays."""
    docs, row = _numbered(docs)
    return _only(docs, exact_groups(docs, row_col=row).where(~F.col("kept")), row, "left_anti")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the first row with the smallest id (NULL last) stays; groups that share an id stay apart."""
    docs, row = _numbered(docs)
    groups = simhash_groups(docs, row_col=row, label_col="label").checkpoint()
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row)
    first = groups.groupBy("label").agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias("stays"))
    return _only(docs, groups.join(first, groups[row] == first["stays"], "left_anti"), row, "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    docs, row = _numbered(docs)
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row_col=row)
    return _only(docs, hits, row, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its place in a sequence of at most 2048 tokens."""
    return pack_sequences(docs, tokenizer_path())


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage),
          ("benchmark_decontamination", decontamination_stage), ("best_fit_packing", packing_stage)]

#: The tagger, the SimHash groups and the packing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again; a stage's rows go once the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
