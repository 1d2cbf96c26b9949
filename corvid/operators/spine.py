"""Entity spines: projection, de-duplication and claimant attachment
(PJ1, PJ2, AG1, AG3, JN1, JN4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_names(cols: Sequence[str]) -> list[str]:
    """Keep the first occurrence of each name (Q9: a repeated projection
    name would make the frame unwritable)."""
    seen, out = set(), []
    for name in cols:
        if name not in seen:
            seen.add(name)
            out.append(name)
    return out


def project_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PJ1 + AG1: project and drop duplicate rows (hash aggregate with a
    map-side partial, so a hot value is combined before the shuffle)."""
    return df.select(*unique_names(columns)).distinct()


def attach(spine: DataFrame, other: DataFrame, on: Sequence[str], columns: Sequence[str],
           how: str = "left", where: Column | None = None, distinct: bool = True,
           inputs_distinct: bool = False) -> DataFrame:
    """JN1 / JN4: project the other side (optionally filtered first, so the
    filter reaches its scan), join on ``on`` and drop duplicate rows.

    A claim with several claimants fans out (one row per claimant); that is
    the intended result, reported by :func:`corvid.operators.quality.fanout_check`.

    With ``inputs_distinct`` the caller vouches that both inputs (after the
    projection) hold no duplicate rows.  Every output row then carries a
    whole row of each side, so two output rows can only be equal if their
    inputs were, and the final de-duplication (a shuffle) is skipped.
    """
    side = other if where is None else other.filter(where)
    side = side.select(*unique_names(list(on) + [c for c in columns if c not in on]))
    out = spine.join(side, on=list(on), how=how)
    return out.distinct() if distinct and not inputs_distinct else out


def one_row_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """AG3: keep exactly one row per key, deterministically.

    The kept row is the smallest by ``order_by`` and then by every other
    column (ascending, NULLs first), so ties cannot make runs differ.

    Expressed as ``min(struct(...))`` per key rather than a ``row_number``
    window: the minimum is combined map-side, so a key holding a third of all
    rows is reduced per input partition before the shuffle instead of being
    sorted whole inside one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in (order_by or []) if c in rest]
    order += [c for c in rest if c not in order]
    if not order:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
