"""The end-to-end loss model: claims master -> null-column drop -> notes ->
cleaned text -> token signals and phrase flags -> matrix -> folds -> scores.

A document stands in for a claim's accident circumstances, bound by id with a
LEFT join over whole tables, so many claims have no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import evaluate as ev
from corvid.operators import lexicon as lx
from corvid.operators import matrix as mx
from corvid.operators import notes as nt
from corvid.operators import quality
from corvid.plans import bindings as b
from corvid.plans import claims_flow as flow

KEY = "claim_number"
TEXT = "circumstances_of_accident"
LABEL = "ft_large_loss1"
NULL_LIMIT = 0.99
# The feature list of the model, by name.
CLAIM_FEATURES = ("insured_liability_position_value", "total_excess", "is_injured", "is_vehicle_parked",
                  "can_vehicle_be_driven", "total_loss_vehicle", "speed_at_impact")
TOKEN_FEATURES = ("cyclist", "ambulance", "motorway", "shop", "property", "child")
PHRASE_FEATURES = ("potential_high_speed", "potential_emergency", "heavy_collision", "many_claimants", "child_injury",
                   "injury_severity", "accident_desc", "illness_type", "claimant_profession", "claimant_circumstance",
                   "accident_outcome", "accident_region", "damaged_premises")
FEATURES = (*CLAIM_FEATURES, *TOKEN_FEATURES, *PHRASE_FEATURES)
NOTE_COLUMNS = (KEY, TEXT, "is_injured", "is_vehicle_parked", "can_vehicle_be_driven", "total_loss_vehicle", "speed_at_impact",
                "total_excess", "insured_liability_position_value", "ft_large_loss1", "ft_large_loss2")


def claims_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Flow B master without its mostly-NULL columns (DQ1), with the circumstances or NULL."""
    master = quality.drop_null_columns(flow.motor_master(spark, d).checkpoint(), NULL_LIMIT)
    texts = b.table(spark, d, "documents").select(F.col("doc_id").alias(KEY), F.col("text").alias(TEXT))
    return master.join(texts, KEY, "left").select(*NOTE_COLUMNS)


def notes(spark: SparkSession, d: str) -> DataFrame:
    """PJ7, notes variant, + FL6: claims that have a text."""
    return claims_with_text(spark, d).filter(F.col(TEXT).isNotNull())


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """FL15 + TX1 + TX8-TX13 + FM1 for every claim; a missing text is the default note."""
    base = claims_with_text(spark, d).withColumn(TEXT, nt.clean_text_expr(TEXT))
    keep = [c for c in NOTE_COLUMNS if c != TEXT]
    signals = lx.token_signals(base, TEXT, lx.TOKEN_LEXICON, keep=[*keep, TEXT])
    flags = lx.phrase_flags(signals, TEXT, lx.PHRASE_LEXICON, keep=[*keep, *TOKEN_FEATURES])
    return mx.numeric_matrix(flags, FEATURES, LABEL, keep=[KEY])


def class_subsets(spark: SparkSession, d: str) -> DataFrame:
    """FL10: the rows of either flag = 1 and = 0, counted."""
    master = flow.motor_master(spark, d).select("ft_large_loss1", "ft_large_loss2").checkpoint()
    out = None
    for flag in ("ft_large_loss1", "ft_large_loss2"):
        sizes = quality.class_sizes(master, flag).select(F.lit(flag).alias("flag"), F.col(flag).alias("value"), "n")
        out = sizes if out is None else out.unionByName(sizes)
    return out


def scores(spark: SparkSession, d: str) -> DataFrame:
    """WN5 + ML8 + AG16 + AG17 on the loss matrix."""
    m = matrix(spark, d).checkpoint()
    folds = ev.stratified_folds(m.select(KEY, LABEL), LABEL, KEY).select(KEY, "fold")
    data = mx.assemble(m.join(folds, KEY), FEATURES, LABEL, keep=[KEY, "fold"])
    gnb = [lr for lr in ev.learners() if lr.name == "Gaussian Naive Bayes"]
    return ev.mean_scores(ev.fold_scores(ev.cross_validate(data, gnb, parallel=5)))
