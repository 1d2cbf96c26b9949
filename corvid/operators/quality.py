"""Data-quality and profiling operators (DQ1-DQ4, AG7-AG10, AG14-AG15, WN2,
FL8).  Each is one aggregate over the input; nothing but a one-row summary
ever reaches the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("claim_number", "data_source"),
                   count_col: str | None = "claim_number") -> DataFrame:
    """DQ2 (WN2 + FL8): rows whose key occurs more than once.

    ``count_col`` reproduces ``count(col) over (partition by keys)``: rows of
    a NULL ``count_col`` are not counted, so NULL-key duplicates escape (Q7).
    ``count_col=None`` counts rows instead.

    Planned as a grouped count (map-side combined), a filter, and a NULL-safe
    semi-join back: the window form would sort a hot key inside one task.
    """
    counter = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    dup = (df.groupBy(*[F.col(k).alias(f"_d{i}") for i, k in enumerate(keys)])
           .agg(counter.alias("_n")).filter(F.col("_n") > 1))
    cond = None
    for i, k in enumerate(keys):
        term = df[k].eqNullSafe(dup[f"_d{i}"])
        cond = term if cond is None else cond & term
    return df.join(dup, cond, "left_semi")


def null_profile(df: DataFrame) -> DataFrame:
    """AG10: NULL count of every column plus the row count, one pass.

    NaN is a value, not NULL.  Output: one row, ``_rows`` then one bigint
    column per input column.
    """
    return df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def null_columns(profile_row: dict, limit_prop: float, guard_empty: bool = False) -> list[str]:
    """Columns whose NULL count is ``>= rows * limit_prop`` (Q12).

    On an empty input every column meets a limit of 0 and would be dropped;
    ``guard_empty`` keeps all columns in that case.
    """
    rows = profile_row["_rows"]
    if guard_empty and rows == 0:
        return []
    limit = rows * limit_prop
    return [k for k, v in profile_row.items() if k != "_rows" and v >= limit]


def drop_null_columns(df: DataFrame, limit_prop: float, guard_empty: bool = False) -> DataFrame:
    """DQ1: drop mostly-NULL columns.  The schema depends on the data, so the
    decision needs one small action: a single aggregate that yields NULL
    counts and the row count together (one job, one scan, one row back)."""
    row = null_profile(df).first().asDict()
    return df.drop(*null_columns(row, limit_prop, guard_empty))


def fanout_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DQ3: rows, distinct keys and the largest rows-per-key of a frame, so a
    join's fan-out is measured instead of eyeballed.  Two aggregation levels,
    both combined map-side."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.sum("_n").cast("long").alias("n_rows"),
                       F.count(F.lit(1)).alias("n_keys"),
                       F.max("_n").cast("long").alias("max_rows_per_key"))


def bounds(df: DataFrame, col: str) -> DataFrame:
    """AG8 / DQ4: global min and max of a column (one partial aggregate)."""
    return df.agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))


def freq_desc(df: DataFrame, col: str) -> DataFrame:
    """AG7 + SO2: value frequencies, most frequent first (value breaks ties)."""
    return df.groupBy(col).count().orderBy(F.desc("count"), F.asc_nulls_first(col))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """AG14 / AG15 / FL10: rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """AG9: attach a row-count metric that is filled in by whatever action
    later runs the frame, instead of a separate full-lineage ``count()``."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
