"""Claims flows A and B as registered queries with their SQL oracles."""

from __future__ import annotations

from corvid.operators import payments as pay
from corvid.operators import quality
from corvid.plans import bindings as b
from corvid.plans import claims_flow as flow
from corvid.plans import oracle as o
from corvid.plans.catalog import register

_A = o.with_(*o.FLOW_A)
_B = o.with_(*o.FLOW_B)


@register("spine_distinct", o.with_(o.CLAIMS, o.SPINE) + "SELECT * FROM spine")
def spine_distinct(spark, d):
    """PJ1 + AG1."""
    return flow.claim_spine(spark, d)


@register("spine_claimants_left",
          o.with_(o.CLAIMS, o.CLAIMANTS, o.SPINE, o.SPINE2) + "SELECT * FROM spine2")
def spine_claimants_left(spark, d):
    """JN1 + PJ2 + AG1."""
    return flow.spine_with_claimants(spark, d)


@register("latest_payment_flag", o.with_(o.CLAIMS, o.PAYMENTS) + """
SELECT p.*, CASE WHEN payment_date = max(payment_date)
                 OVER (PARTITION BY claim_number, claimant_number) THEN 1 ELSE 0 END AS "max"
FROM payments p""")
def latest_payment_flag(spark, d):
    """WN1 over every payment row."""
    return pay.latest_flag(b.payments(spark, d))


@register("paid_section_filter", o.with_(o.CLAIMS, o.PAYMENTS, o.INJURY) + "SELECT * FROM injury")
def paid_section_filter(spark, d):
    """WN1 -> FL1/FL2 -> AG1."""
    return flow.injury_payments(spark, d)


@register("payment_category",
          o.with_(o.CLAIMS, o.PAYMENTS, o.INJURY, o.FEAT) + "SELECT * FROM feat")
def payment_category(spark, d):
    """FL11 + AG2."""
    return flow.payment_features(spark, d)


@register("payment_pivot_totals", _A + "SELECT * FROM flagged")
def payment_pivot_totals(spark, d):
    """JN2 + AG4 + AG5 + FL12."""
    return flow.payment_pivot(spark, d)


_ONE_ORDER = [c for c in o.PIVOT_OUT if c != "claim_number"]


@register("one_row_per_claim", _A + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_number ORDER BY {o.total_order(_ONE_ORDER)}) AS rn
  FROM flagged WHERE lob IN {o.LOBS}) WHERE rn = 1""")
def one_row_per_claim(spark, d):
    """FL3/FL4 + AG3 (total tie-break order)."""
    return flow.motor_one_per_claim(spark, d)


@register("checkpoint_counts", _A + f"""
SELECT 0 AS step, 'claim_spine' AS name, (SELECT count(*) FROM spine) AS n_rows
UNION ALL SELECT 1, 'claimants_attached', (SELECT count(*) FROM spine2)
UNION ALL SELECT 2, 'payment_features', (SELECT count(*) FROM feat)
UNION ALL SELECT 3, 'payment_pivot', (SELECT count(*) FROM flagged)
UNION ALL SELECT 4, 'one_row_per_claim', (SELECT count(DISTINCT claim_number) FROM flagged WHERE lob IN {o.LOBS})""")
def checkpoint_counts(spark, d):
    """AG9: the counts between the steps of flow A, observed along one run."""
    return flow.checkpoint_counts(spark, d)


@register("duplicate_keys", o.with_(o.CLAIMS, o.CLAIMANTS, o.SPINE, o.SPINE2) + """
SELECT * EXCLUDE (dupe_count) FROM (
  SELECT *, count(claim_number) OVER (PARTITION BY claim_number, data_source) AS dupe_count
  FROM spine2) WHERE dupe_count > 1""")
def duplicate_keys(spark, d):
    """WN2 + FL8 + DQ2 on the claimant spine (a claim has many claimants)."""
    return quality.duplicate_keys(flow.spine_with_claimants(spark, d).checkpoint())   # counted and filtered: built once


@register("closed_claim_paid", o.with_(o.CLAIMS, o.PAYMENTS, o.CLOSED) + "SELECT * FROM closed")
def closed_claim_paid(spark, d):
    """FL4 + AG6 + PJ5 + JN3 + FL14 + FL12."""
    return flow.closed_claim_paid(spark, d)


@register("third_party_join", _B + "SELECT * FROM master")
def third_party_join(spark, d):
    """JN4 + AG3 + FL13 + FL14."""
    return flow.motor_master(spark, d)


@register("freq_desc", _B + """
SELECT is_injured, count(*) AS count FROM third GROUP BY is_injured""")
def freq_desc(spark, d):
    """AG7 + SO2."""
    return flow.injured_frequency(spark, d)


@register("model_columns", _B + f"""
SELECT {", ".join(flow.MODEL_COLUMNS)} FROM master
WHERE claim_notification_date > DATE '1996-01-01'""")
def model_columns(spark, d):
    """FL5 + PJ7."""
    return flow.model_columns(spark, d)
