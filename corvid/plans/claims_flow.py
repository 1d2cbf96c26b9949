"""Claims flows on the bound tables.

Flow A (claimant-level payment features): claim spine -> claimants ->
latest-flagged paid payments -> categories -> right join -> pivot/totals/flags
-> one row per claim.

Flow B (closed-claim spine): paid totals per claim -> closed claims ->
flags -> third-party claimants -> one row per claim -> recodes -> model columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import payments as pay
from corvid.operators import quality, recode, spine
from corvid.plans import bindings as b

JOIN_KEYS = ["claim_number", "data_source"]


# -- flow A ------------------------------------------------------------------

def claim_spine(spark: SparkSession, d: str) -> DataFrame:
    return spine.project_distinct(b.claims(spark, d), b.SPINE_COLUMNS)


def spine_with_claimants(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """JN1; ``only`` restricts both sides to its claims before they are made distinct."""
    # The spine is de-duplicated and the claimant binding is distinct (its
    # line columns are de-duplicated, the rest follows 1:1 from unique keys).
    claims = spine.project_distinct(b.claims(spark, d) if only is None else b.claims(spark, d).join(only, "claim_number", "left_semi"),
                                    b.SPINE_COLUMNS)
    return spine.attach(claims, b.claimants(spark, d, only), on=JOIN_KEYS,
                        columns=b.CLAIMANT_COLUMNS, how="left", inputs_distinct=True)


def injury_payments(spark: SparkSession, d: str, keep: str = "all") -> DataFrame:
    return pay.paid_payments(b.payments(spark, d), b.BINDING.paid, keep=keep)


def payment_features(spark: SparkSession, d: str) -> DataFrame:
    return pay.categorise(injury_payments(spark, d), b.BINDING.rules, input_distinct=True)


def payment_pivot(spark: SparkSession, d: str) -> DataFrame:
    # The right join keeps paid claims only: build the spine of just those.
    # The features are few and read twice.
    features = payment_features(spark, d).checkpoint()
    paid = features.select("claim_number").distinct()
    return pay.pivot_payments(spine_with_claimants(spark, d, paid), features)


def motor_one_per_claim(spark: SparkSession, d: str) -> DataFrame:
    """Pivot rows of the chosen lines of business, one per claim.  The pivot
    rows already satisfy the paid filter (its columns are grouping columns)
    and are distinct, so only the line-of-business filter remains."""
    piv = payment_pivot(spark, d).filter(F.col("lob").isin(list(b.BINDING.lobs)))
    return spine.one_row_per_key(piv, ["claim_number"])


def checkpoint_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG9: the row counts that the source takes between the steps of flow A,
    all from one execution: each step carries an observed count, filled in
    while the last step runs."""
    seen = []

    def step(name: str, df: DataFrame) -> DataFrame:
        df, obs = quality.counted(df, name)
        seen.append((name, obs))
        return df
    claims = step("claim_spine", claim_spine(spark, d))
    with_claimants = step("claimants_attached", spine.attach(claims, b.claimants(spark, d), on=JOIN_KEYS, columns=b.CLAIMANT_COLUMNS,
                                                             how="left", inputs_distinct=True))
    features = step("payment_features", payment_features(spark, d))
    pivot = step("payment_pivot", pay.pivot_payments(with_claimants, features))
    last = step("one_row_per_claim", spine.one_row_per_key(pivot.filter(F.col("lob").isin(list(b.BINDING.lobs))), ["claim_number"]))
    last.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(i, name, obs.get["rows"]) for i, (name, obs) in enumerate(seen)], "step int, name string, n_rows long")


# -- flow B ------------------------------------------------------------------

def motor_payments(spark: SparkSession, d: str) -> DataFrame:
    p = b.BINDING.paid
    return (b.line_payments(spark, d)
            .filter(F.col("lob").isin(list(b.BINDING.lobs)))
            .filter((F.col(p.section_col) == p.section) & (F.col(p.status_col) == p.status)))


def closed_claim_paid(spark: SparkSession, d: str) -> DataFrame:
    closed = (b.claims(spark, d)
              .filter(F.col("lob").isin(list(b.BINDING.lobs)))
              .filter(F.col("claim_status") == b.BINDING.closed_status)
              .distinct())
    totals = pay.sum_per_key(motor_payments(spark, d), "claim_number")
    out = pay.attach_totals(closed, totals)
    return pay.add_loss_flags(out, "total_paid")


def third_party_spine(spark: SparkSession, d: str) -> DataFrame:
    # Closed claims are made distinct before their one total joins them, and
    # the claimant binding is distinct: the join needs no de-duplication.
    return spine.attach(closed_claim_paid(spark, d), b.claimants(spark, d), on=JOIN_KEYS,
                        columns=b.CLAIMANT_COLUMNS, how="left",
                        where=F.col("claimant_type") == b.BINDING.third_party, inputs_distinct=True)


RECODES = {"is_injured": "true", "is_vehicle_parked": "true", "can_vehicle_be_driven": "Yes"}


def motor_master(spark: SparkSession, d: str) -> DataFrame:
    """One row per claim, indicators recoded, string fill of the total-loss
    column."""
    mst = spine.one_row_per_key(third_party_spine(spark, d), ["claim_number"])
    mst = recode.recode_indicators(mst, RECODES)
    return recode.fill_nulls(mst, "0", ["total_loss_vehicle"])


MODEL_COLUMNS = ("claim_number", "is_injured", "is_vehicle_parked", "can_vehicle_be_driven",
                 "total_loss_vehicle", "ft_large_loss1", "total_excess", "speed_at_impact",
                 "insured_liability_position_value", "ft_large_loss2")


def model_columns(spark: SparkSession, d: str) -> DataFrame:
    """FL5 + PJ7: notified strictly after the cut-off date (NULL dropped)."""
    mst = motor_master(spark, d)
    return mst.filter(F.col("claim_notification_date") > F.lit(b.BINDING.since).cast("date")) \
              .select(*MODEL_COLUMNS)


def injured_frequency(spark: SparkSession, d: str) -> DataFrame:
    return quality.freq_desc(third_party_spine(spark, d), "is_injured")
