"""Payment features: latest flag, paid filter, categorisation, pivot, totals
and large-loss flags (WN1, FL1, FL2, FL11, FL12, AG2, AG4-AG6, JN2, JN3)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.columns import (between_open_flag, units_to_amount, equals_or_null, gt_flag,
                                      isin_or_eq, money_sum, to_units)

# ---------------------------------------------------------------------------
# The five payment categories, the derived totals, the three
# large-loss flags and their thresholds.
# ---------------------------------------------------------------------------
OUR_LEGAL = "ft_case_pay_our_legal_spend"
PSLA = "ft_case_pay_psla_amount"
CLAIMANT_LEGAL = "ft_case_pay_claimant_legal_spend"
OTHER_COSTS = "ft_case_pay_other_costs"
SPECIAL_DAMAGES = "ft_case_pay_special_damages_spend"
CATEGORIES = (OUR_LEGAL, PSLA, CLAIMANT_LEGAL, OTHER_COSTS, SPECIAL_DAMAGES)
TOTAL_LEGAL = "ft_case_pay_total_legal_spend"
TOTAL_SPEND = "ft_pay_total_spend"
LARGE_LOSS_LOW = 100000
LARGE_LOSS_HIGH = 300000
CATEGORY_COL = "ft_payment_desc_category"

# Pivot grouping columns of the claimant-level payment table.
PIVOT_GROUP = ("data_source", "claim_number", "claimant_number", "lob", "claim_notification_date",
               "claim_status", "section", "clean_payment_status", "transaction_type")
PAYMENT_JOIN_KEYS = ("claim_number", "claimant_number", "lob", "data_source")


@dataclass(frozen=True)
class CategoryRules:
    """Value sets of the ordered payment categorisation (FL11).

    Fixed values: the defaults are the source pipeline's grouping codes and
    description texts, in its order.
    """
    grouping_col: str = "payment_grouping1"
    desc_col: str = "payment_desc"
    amount_col: str = "payment_amount"
    our_legal_groups: tuple = ("Our Solicitors",)
    psla_groups: tuple = ("General Damages",)
    claimant_legal_groups: tuple = ("Claimant Solicitors",)
    medical_descs: tuple = ("TPI - Medical Expenses", "Medical Reports", "Medical Report Fee")
    medical_fee_amounts: tuple = (216, 780)
    claimant_cost_descs: tuple = ("Claimant Costs, Fees and Disbursements",)
    hospital_descs: tuple = ("TPPI - Hospital Charges", "TPI - Hospital Charges", "NHS In Patient",
                             "NHS Ambulance", "NHS Inpatients Charges")
    special_groups: tuple = ("Special Damages",)


@dataclass(frozen=True)
class PaidFilter:
    """Which payments count as paid injury payments (FL1, FL2)."""
    section: str = "TPI"
    status: str = "Paid"
    transaction_type: str = "1"
    section_col: str = "section"
    status_col: str = "clean_payment_status"
    type_col: str = "transaction_type"

    def predicate(self) -> Column:
        return ((F.col(self.section_col) == F.lit(self.section))
                & (F.col(self.status_col) == F.lit(self.status))
                & equals_or_null(self.type_col, self.transaction_type))


def latest_flag(df: DataFrame, keys: Sequence[str] = ("claim_number", "claimant_number"),
                date_col: str = "payment_date", name: str = "max") -> DataFrame:
    """WN1: 1 where the row's date equals the latest date of its key, else 0
    (NULL date or all-NULL key group gives 0).

    Same result as ``max(date) over (partition by keys)``, planned as a
    grouped max joined back on the keys (NULL-safe, so NULL keys form one
    group like a window partition).  The max is combined map-side and AQE
    can broadcast it or split a skewed key, where a window would sort a hot
    key's rows inside one task; filters placed on the result also sink below
    the join to the scan.
    """
    latest = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max(date_col).alias("_latest"))
    cond = None
    for i, k in enumerate(keys):
        term = df[k].eqNullSafe(latest[f"_k{i}"])
        cond = term if cond is None else cond & term
    joined = df.join(latest, cond, "left")
    flag = F.when(F.col(date_col) == F.col("_latest"), F.lit(1)).otherwise(F.lit(0))
    return joined.select(*[df[c] for c in df.columns], flag.alias(name))


def paid_payments(payments: DataFrame, paid: PaidFilter = PaidFilter(), keep: str = "all",
                  keys: Sequence[str] = ("claim_number", "claimant_number"),
                  date_col: str = "payment_date") -> DataFrame:
    """Flag latest payments over *all* rows of a key, then keep paid injury
    payments and drop duplicate rows (WN1 -> FL1/FL2 -> AG1).

    ``keep="latest"`` additionally keeps only rows flagged latest.
    """
    out = latest_flag(payments, keys, date_col).filter(paid.predicate())
    if keep == "latest":
        out = out.filter(F.col("max") == 1)
    elif keep != "all":
        raise ValueError("keep must be 'all' or 'latest'")
    return out.distinct()


def category_expr(rules: CategoryRules = CategoryRules()) -> Column:
    """FL11: ordered categorisation; the first matching branch wins and a
    NULL input falls through to the fallback category."""
    g, d, a = F.col(rules.grouping_col), F.col(rules.desc_col), F.col(rules.amount_col)
    branches = [
        (isin_or_eq(g, rules.our_legal_groups), OUR_LEGAL),
        (isin_or_eq(g, rules.psla_groups), PSLA),
        (isin_or_eq(g, rules.claimant_legal_groups), CLAIMANT_LEGAL),
        (isin_or_eq(d, rules.medical_descs) & isin_or_eq(a, rules.medical_fee_amounts), CLAIMANT_LEGAL),
        (isin_or_eq(d, rules.claimant_cost_descs), CLAIMANT_LEGAL),
        (isin_or_eq(d, rules.hospital_descs), OTHER_COSTS),
        (isin_or_eq(g, rules.special_groups), SPECIAL_DAMAGES),
    ]
    expr = None
    for cond, value in branches:
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(OTHER_COSTS))


def categorise(df: DataFrame, rules: CategoryRules = CategoryRules(),
               input_distinct: bool = False) -> DataFrame:
    """FL11 + AG2: add the category column, then drop duplicate rows.

    The category is a function of existing columns, so when the input is
    already distinct (``input_distinct``) the second de-duplication cannot
    remove anything and its shuffle is skipped.
    """
    out = df.withColumn(CATEGORY_COL, category_expr(rules))
    return out if input_distinct else out.dropDuplicates()


def pivot_payments(spine: DataFrame, payment_feat: DataFrame,
                   join_keys: Sequence[str] = PAYMENT_JOIN_KEYS,
                   group_cols: Sequence[str] = PIVOT_GROUP,
                   amount_col: str = "payment_amount",
                   categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """JN2 + AG4 + AG5 + FL12: right-join the spine to the categorised
    payments, sum amounts per group into one column per category, add the
    legal and grand totals and the three large-loss flags.

    The category values are passed explicitly, so no extra job lists them
    and an absent category is a NULL column.  The pivot is written as one
    conditional sum per category: a single hash aggregate (``pivot()``
    would add a second aggregation level and shuffle).  Its grouping keys
    contain the join keys, so it reuses the join's partitioning.  Sums run
    on integers (exact, order independent); totals use the same integers.
    """
    joined = spine.join(payment_feat, on=list(join_keys), how="right")
    units = to_units(amount_col)
    piv = joined.groupBy(*group_cols).agg(
        *[F.sum(F.when(F.col(CATEGORY_COL) == F.lit(k), units)).alias(k) for k in categories])
    legal = [OUR_LEGAL, CLAIMANT_LEGAL]
    total_legal = _units_total(legal)
    total = _units_total([OUR_LEGAL, CLAIMANT_LEGAL, SPECIAL_DAMAGES, PSLA, OTHER_COSTS])
    out = piv.select(*group_cols,
                     *[units_to_amount(F.col(k)).alias(k) for k in categories],
                     units_to_amount(total_legal).alias(TOTAL_LEGAL),
                     units_to_amount(total).alias(TOTAL_SPEND))
    return add_loss_flags(out, TOTAL_SPEND)


def _units_total(cols: Sequence[str]) -> Column:
    out = None
    for k in cols:
        term = F.coalesce(F.col(k), F.lit(0).cast("long"))
        out = term if out is None else out + term
    return out


def add_loss_flags(df: DataFrame, total_col: str, low: float = LARGE_LOSS_LOW,
                   high: float = LARGE_LOSS_HIGH) -> DataFrame:
    """FL12: ``>low``, ``>high`` and strictly between; NULL gives 0."""
    return df.withColumns({
        "ft_large_loss1": gt_flag(total_col, low),
        "ft_large_loss2": gt_flag(total_col, high),
        "ft_large_loss3": between_open_flag(total_col, low, high),
    })


def sum_per_key(df: DataFrame, key: str | Sequence[str], amount_col: str = "payment_amount",
                name: str = "total_paid") -> DataFrame:
    """AG6 + PJ5: exact money sum per key, named at aggregation time."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(money_sum(amount_col).alias(name))


def attach_totals(claims: DataFrame, totals: DataFrame, key: str = "claim_number",
                  name: str = "total_paid") -> DataFrame:
    """JN3 + FL14: left-join pre-aggregated totals; no payment -> 0.

    ``totals`` is already hash-partitioned on ``key`` by its aggregation, so
    only the claims side moves for the join.
    """
    return claims.join(totals, on=key, how="left").fillna(0, subset=[name])
