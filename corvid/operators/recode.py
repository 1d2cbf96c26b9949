"""Recodes and fills (FL13, FL14, FN8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from corvid.functions.columns import indicator, to_number


def recode_indicators(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """FL13: overwrite each column with 1 where it equals its true value
    (e.g. ``'true'`` or ``'Yes'``), else 0; NULL gives 0."""
    return df.withColumns({col: indicator(col, true_value) for col, true_value in spec.items()})


def fill_nulls(df: DataFrame, value, subset: Sequence[str]) -> DataFrame:
    """FL14, type-checked (Q10): ``na.fill`` silently skips columns of the
    other type; here a mismatch is an error instead of a no-op."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    want = StringType if isinstance(value, str) else NumericType
    bad = [c for c in subset if not isinstance(types[c], want)]
    if bad:
        raise TypeError(f"fill value {value!r} does not match the type of {bad}")
    return df.fillna(value, subset=list(subset))


def coerce_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """FN8: ``try_cast(c AS DOUBLE)`` with NULL -> 0 over a column list; a
    repeated name is kept once."""
    seen, cols = set(), []
    for c in columns:
        if c not in seen:
            seen.add(c)
            cols.append(c)
    return df.select(*keep, *[to_number(c).alias(c) for c in cols])
