"""Feature matrix (FM1, FM2, FN8, PJ10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators.recode import coerce_numeric


def numeric_matrix(df: DataFrame, features: Sequence[str], label: str,
                   keep: Sequence[str] = ()) -> DataFrame:
    """FM1 + FN8: the listed columns coerced to double (unparsable -> 0, a
    repeated name kept once) plus the label as double."""
    feats = [c for c in dict.fromkeys(features) if c != label]
    return coerce_numeric(df, [*feats, label], keep=keep)


def assemble(df: DataFrame, features: Sequence[str], label: str,
             out: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """FM2 + PJ10: features as one vector column, the label kept apart."""
    feats = [c for c in dict.fromkeys(features) if c != label]
    vec = VectorAssembler(inputCols=feats, outputCol=out, handleInvalid="keep")
    return vec.transform(df).select(*keep, out, F.col(label).cast("double").alias("label"))
