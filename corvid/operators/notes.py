"""Free-text notes: timestamp parsing, boilerplate filter, ordered
per-claim concatenation, text cleaning (FN2-FN5, FN7, FN11, FL6, FL7,
FL15, AG11, AG12, JN5, JN6, TX1-TX3, PJ6, PJ8)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvid.session import written

NOTE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Boilerplate note prefixes (matched case-sensitively, before
# lower-casing) and the default text for a missing note.
BOILERPLATE_PREFIXES = ("Blackboard", "Initial Utterance")
MISSING_NOTE = "no note"
#: Notes of one key that a task joins at most.
ROWS_PER_TASK = 100_000
# Characters kept by the text clean (regex class body).
KEPT = "a-zA-Z0-9."


def parse_note_time(df: DataFrame, col: str = "transaction_date",
                    fmt: str = NOTE_TIME_FORMAT) -> DataFrame:
    """FN2: ``notes_date`` (date) and ``notes_date_time`` (timestamp, wall
    clock) from a text or timestamp column.  An unparsable or partial string
    gives NULL instead of failing the job (ANSI mode would raise)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, StringType):
        ts = F.try_to_timestamp(F.col(col), F.lit(fmt)).cast("timestamp_ntz")
    else:
        ts = F.col(col).cast("timestamp_ntz")
    return df.withColumns({"notes_date": ts.cast("date"), "notes_date_time": ts})


def not_boilerplate(col: str, prefixes: Sequence[str] = BOILERPLATE_PREFIXES) -> Column:
    """FL7 / FN11: drop notes starting with any prefix (case-sensitive).  A
    NULL text is dropped as well, as with ``NOT LIKE``."""
    cond = None
    for p in prefixes:
        term = ~F.col(col).startswith(p)
        cond = term if cond is None else cond & term
    return cond


def ordered_concat(texts: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                   text_col: str, sep: str = "~", count_name: str = "number_of_notes",
                   count_col: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """AG11 + AG12: per key, the number of notes and their texts joined by
    ``sep`` in ``order_cols`` order (ascending, NULLs first; the text itself
    breaks remaining ties).  NULL texts are skipped by the join but counted
    like the source did (``count(count_col)``).

    The notes of a key meet in one task.  A key of more than
    ``rows_per_task`` notes is joined in two levels instead: its notes are cut
    into ranges of the order, each range is joined by a task of its own, and
    the last task joins one string per range.  Finding such keys reads the
    key columns only; without them the plan is the simple one.
    """
    texts = texts.select(*dict.fromkeys([*keys, *order_cols, text_col, *([count_col] if count_col else [])]))
    counted = F.col(count_col or keys[0])
    of_key = lambda name: [F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)]
    many = texts.groupBy(*keys).count().where(F.col("count") > rows_per_task).select(*of_key("_k"), "count")
    whole, out = texts, None
    if not many.isEmpty():
        many = written(many)
        same = None
        for i, k in enumerate(keys):
            term = texts[k].eqNullSafe(many[f"_k{i}"])
            same = term if same is None else same & term
        whole = texts.join(many, same, "left_anti")
        parts = math.ceil(many.agg(F.sum("count")).first()[0] / rows_per_task)
        ranges = ordered_ranges(texts.join(many, same, "left_semi"), keys, [*order_cols, text_col], parts)
        joined = _joined(ranges, [*keys, "_range"], order_cols, text_col, sep, counted)
        # Ranges without a text would leave an empty piece between two separators.
        pieces = F.array_sort(F.collect_list(F.when(F.col("_some") > 0, F.struct("_range", "_text"))))
        out = joined.groupBy(*keys).agg(F.sum("_n").alias(count_name), F.concat_ws(sep, F.transform(pieces, lambda s: s["_text"])).alias(text_col))
    simple = _joined(whole, keys, order_cols, text_col, sep, counted).select(*keys, F.col("_n").alias(count_name), F.col("_text").alias(text_col))
    return simple if out is None else simple.unionByName(out)


def ordered_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    """``rows`` in ``parts`` ranges of (keys, order), with the range's number ``_range``."""
    return rows.repartitionByRange(max(1, parts), *dict.fromkeys([*keys, *order])).withColumn("_range", F.spark_partition_id())


def _joined(rows: DataFrame, keys: Sequence[str], order_cols: Sequence[str], text_col: str, sep: str, counted: Column) -> DataFrame:
    """(keys, _n, _some, _text): rows counted, texts that are not NULL, and these joined in order."""
    parts = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], F.col(text_col).alias("_t"))
    agg = rows.groupBy(*keys).agg(F.count(counted).alias("_n"), F.count(text_col).alias("_some"), F.array_sort(F.collect_list(parts)).alias("_parts"))
    return agg.select(*keys, "_n", "_some", F.concat_ws(sep, F.transform("_parts", lambda s: s["_t"])).alias("_text"))


def notes_same_day(master: DataFrame, notes: DataFrame, key: str = "claim_number",
                   master_date: str = "claim_notification_date", order_cols: Sequence[str] = ("notes_date_time",),
                   text_col: str = "fnol_notes",
                   prefixes: Sequence[str] = BOILERPLATE_PREFIXES) -> DataFrame:
    """TX2 (JN5 + FL7 + AG11/AG12 + FN3): notes written on the claim's
    notification date, boilerplate removed, concatenated in time order and
    lower-cased.  Output: key, notes_date, number_of_notes, text."""
    m = master.select(F.col(key), F.col(master_date).alias("notes_date"))
    joined = notes.join(m, on=[key, "notes_date"], how="inner").filter(not_boilerplate(text_col, prefixes))
    out = ordered_concat(joined, [key, "notes_date"], order_cols, text_col)
    return out.withColumn(text_col, F.lower(text_col))


def notes_all(master: DataFrame, notes: DataFrame, key: str = "claim_number",
              order_cols: Sequence[str] = ("notes_date_time",), text_col: str = "fnol_notes",
              prefixes: Sequence[str] = BOILERPLATE_PREFIXES) -> DataFrame:
    """TX3 (JN6 + FL7 + AG11/AG12 + FN3 + PJ6): notes of every date.
    Output: key, number_of_notes_all, all_notes."""
    joined = (notes.join(master.select(key), on=key, how="inner")
              .filter(not_boilerplate(text_col, prefixes)))
    out = ordered_concat(joined, [key], order_cols, text_col, count_name="number_of_notes_all")
    return out.select(key, "number_of_notes_all", F.lower(text_col).alias("all_notes"))


def clean_text_expr(col: str, default: str = MISSING_NOTE) -> Column:
    """TX1 (FL15 + FN4 + FN5 + FN3): NULL -> default; every character but
    ASCII letters, digits and '.' -> space; runs of spaces -> one space (no
    trim); lower case.

    The space is itself a replaced character, so "replace each, then
    collapse space runs" equals replacing each maximal run of replaced
    characters by one space, i.e. the runs of kept characters joined by one
    space, with one more space in front (behind) when the text starts (ends)
    with a replaced character.  It is written that way because
    ``regexp_extract_all`` scales with executor threads while
    ``regexp_replace`` did not (measured: 8 threads slower than 1).
    Lower-casing stays last (some non-ASCII letters lower-case to ASCII).
    """
    t = F.coalesce(F.col(col), F.lit(default))
    runs = F.regexp_extract_all(t, F.lit(f"[{KEPT}]+"), 0)
    outside = f"[^{KEPT}]"
    lead = F.when(F.substring(t, 1, 1).rlike(outside), F.lit(" ")).otherwise(F.lit(""))
    trail = (F.when((F.size(runs) > 0) & F.substring(t, -1, 1).rlike(outside), F.lit(" "))
             .otherwise(F.lit("")))
    return F.lower(F.concat(lead, F.array_join(runs, " "), trail))


def clean_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, clean_text_expr(col))
