"""Exact ranks and running sums within groups without a window over whole groups.

``row_number() over (partition by g order by o)`` sends a whole group (or,
without ``g``, the whole table) through one task.  Here all rows are range
partitioned and sorted by (group, order), so a row's place in its partition
is known from the sort; the rank is that place, less the first place of the
group in the partition, plus the group's rows in earlier partitions.  The
table of (partition, group) counts is the only thing windowed.  There is one
code path at every size; ties on the first order column are split by the
next ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000_000


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                name: str = "_rank", rows_per_bucket: int = ROWS_PER_BUCKET,
                n_rows: int | None = None) -> DataFrame:
    """Add a 0-based rank of each row inside its group by ``order_cols``
    (ascending, NULL first, NaN last, as in a window; rows that tie on all of
    them are ranked in any order, each once).

    NULL groups are groups, and no row is lost or repeated.  The result is
    checkpointed: ranks must not change when a lost executor's work is redone.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    n = df.count() if n_rows is None else n_rows
    parts = max(1, math.ceil(n / rows_per_bucket))
    pid, place, first, before = (f"{name}_{x}" for x in ("pid", "place", "first", "before"))
    number = F.monotonically_increasing_id()
    staged = (df.repartitionByRange(parts, *group_cols, *order_cols)
              .sortWithinPartitions(*group_cols, *order_cols)
              .withColumn(place, number)
              .withColumn(pid, F.shiftright(place, 33))
              .withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
              .checkpoint())
    counts = staged.groupBy(pid, *group_cols).agg(F.min(place).alias(first), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group_cols).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g).alias(f"{name}_g{i}") for i, g in enumerate(group_cols)]
    offsets = counts.select(F.col(pid).alias(f"{pid}2"), *keys, first,
                            F.coalesce(F.sum("_c").over(w), F.lit(0)).alias(before))
    on = staged[pid] == offsets[f"{pid}2"]
    for i, g in enumerate(group_cols):
        on = on & staged[g].eqNullSafe(offsets[f"{name}_g{i}"])
    rank = (F.col(place) - F.col(first) + F.col(before)).cast("long")
    return staged.join(offsets, on).select(*[staged[c] for c in df.columns], rank.alias(name))


def running_sums(df: DataFrame, group_cols: Sequence[str], order_col: str, sum_cols: Sequence[str],
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add, for rows unique in (group, ``order_col``), ``<c>_upto``: the sum of ``c`` over the group's rows up to this
    one in the order, and ``<order_col>_next``: the next row's ``order_col`` (NULL in the last).

    Rows are range partitioned by (group, order); sums run inside a
    partition's part of a group, and what the group holds in earlier
    partitions is added from the table of (partition, group) sums.  NULL
    orders come first; the result is checkpointed before the sums.
    """
    group_cols, sum_cols = list(group_cols), list(sum_cols)
    parts = max(1, math.ceil(df.count() / rows_per_bucket))
    staged = (df.repartitionByRange(parts, *group_cols, order_col)
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    here = Window.partitionBy("_pid", *group_cols).orderBy(order_col)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    local = staged.select("*", *[F.sum(c).over(upto).alias(f"{c}_upto") for c in sum_cols],
                          F.lead(order_col).over(here).alias("_lead"))
    held = staged.groupBy("_pid", *group_cols).agg(*[F.sum(c).alias(f"_{c}") for c in sum_cols], F.min(order_col).alias("_first"))
    across = Window.partitionBy(*group_cols).orderBy("_pid")
    earlier = held.select(F.col("_pid").alias("_pid2"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)],
                          *[F.coalesce(F.sum(f"_{c}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}_before") for c in sum_cols],
                          F.lead("_first").over(across).alias("_first_after"))
    on = local["_pid"] == earlier["_pid2"]
    for i, g in enumerate(group_cols):
        on = on & local[g].eqNullSafe(earlier[f"_g{i}"])
    return local.join(earlier, on).select(*[local[c] for c in df.columns],
                                          *[(F.col(f"{c}_upto") + F.col(f"_{c}_before")).alias(f"{c}_upto") for c in sum_cols],
                                          F.coalesce("_lead", "_first_after").alias(f"{order_col}_next"))
