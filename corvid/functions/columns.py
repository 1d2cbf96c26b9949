"""Column-expression helpers.  Everything here returns a ``Column`` built from
built-in functions, so it stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColLike = "Column | str"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def equals_or_null(col, value) -> Column:
    """``col == value OR col IS NULL`` (FL2)."""
    col = c(col)
    return (col == F.lit(value)) | col.isNull()


def to_units(amount, scale: int = 6) -> Column:
    """Money as an exact integer of 10^-scale.

    Summing integers as ``long`` is exact and independent of summation order,
    and stays a fixed-width codegen'd hash-aggregate buffer (a wide decimal
    sum would fall back to ``BigDecimal``).  Nothing is rounded away: an amount
    with more decimals than ``scale`` is an error.
    """
    scaled = c(amount).cast("double") * F.lit(float(10 ** scale))
    fits = F.abs(scaled - F.round(scaled)) <= F.lit(1e-6) + F.abs(scaled) * F.lit(1e-15)
    return F.when(scaled.isNull() | fits, F.round(scaled).cast("long")).otherwise(
        F.raise_error(F.format_string(f"amount %s has more than {scale} decimals", c(amount).cast("string"))).cast("long"))


def units_to_amount(units, scale: int = 6) -> Column:
    return c(units).cast("double") / F.lit(float(10 ** scale))


def money_sum(amount, scale: int = 6) -> Column:
    """Exact, order-independent sum of a money column, as double."""
    return units_to_amount(F.sum(to_units(amount, scale)), scale)


def gt_flag(col, threshold) -> Column:
    """1 if ``col > threshold`` else 0; NULL gives 0 (FL12)."""
    return F.when(c(col) > F.lit(threshold), F.lit(1)).otherwise(F.lit(0))


def between_open_flag(col, low, high) -> Column:
    """1 if ``low < col < high`` (both strict) else 0; NULL gives 0."""
    col = c(col)
    return (F.when((col > F.lit(low)) & (col < F.lit(high)), F.lit(1))
            .otherwise(F.lit(0)))


def indicator(col, true_value) -> Column:
    """1 if ``col == true_value`` else 0; NULL gives 0 (FL13).

    Works for string columns and for real booleans compared with 'true'.
    """
    col = c(col)
    return F.when(col.cast("string") == F.lit(str(true_value)), F.lit(1)).otherwise(F.lit(0))


def to_number(col, default: float = 0.0) -> Column:
    """Loose numeric coercion: unparsable or NULL -> ``default`` (FN8)."""
    return F.coalesce(F.expr(f"try_cast({_sql_ref(col)} AS DOUBLE)"), F.lit(default))


def _sql_ref(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("to_number takes a column name")


MASK32 = (1 << 32) - 1
MIX = 73244475


def seed_word(seed: int, salt: int = 0) -> int:
    return (seed * 2654435769 + salt * 2246822519) & MASK32


def mix_hash(id_col, seed: int, salt: int = 0) -> Column:
    """Portable seeded 32-bit hash: xor-shift and multiply, twice.

    All intermediates stay below 2^63, so any SQL engine computes the same
    numbers and draws made with it can be checked against an oracle.  Draws of
    different purposes take different salts.
    """
    x = c(id_col).cast("long")
    h = x.bitwiseXOR(F.shiftright(x, 32)).bitwiseXOR(F.lit(seed_word(seed, salt))).bitwiseAND(F.lit(MASK32))
    for _ in range(2):
        h = (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(MIX)).bitwiseAND(F.lit(MASK32))
    return h.bitwiseXOR(F.shiftright(h, 16))


def mix_hash_sql(x: str, seed: int, salt: int = 0) -> str:
    """The same number in DuckDB SQL."""
    h = f"(xor(xor(CAST({x} AS BIGINT), CAST({x} AS BIGINT) >> 32), {seed_word(seed, salt)}) & {MASK32})"
    for _ in range(2):
        h = f"((xor({h}, {h} >> 16) * {MIX}) & {MASK32})"
    return f"xor({h}, {h} >> 16)"


def pick_draw(id_col, n: int, seed: int, salt: int = 0) -> Column:
    """A draw from 1..n, from the high bits of the hash."""
    return (F.shiftright(mix_hash(id_col, seed, salt) * F.lit(n), 32) + 1).cast("int")


def unit_draw(id_col, seed: int, salt: int = 1) -> Column:
    """A draw in [0, 1)."""
    return mix_hash(id_col, seed, salt).cast("double") / F.lit(float(1 << 32))


def isin_or_eq(col, values: Iterable) -> Column:
    values = list(values)
    return c(col) == F.lit(values[0]) if len(values) == 1 else c(col).isin(values)
