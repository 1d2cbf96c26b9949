"""Role bindings: the driver's TPC-H-style tables presented in the roles the
operators expect (claims, payments, claimants, notes, free text).

Each binding is a projection (plus, where a role needs a column held by
another table, an equi-join), so filters and column pruning placed later
still reach the Parquet scans.  The SQL twin of every binding lives in
``corvid.plans.oracle``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.payments import CategoryRules, PaidFilter

SOURCE_TAG = "tpch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as claims: key, line of business, status (F = closed),
    notification date, an amount column and the customer key."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lit(SOURCE_TAG).alias("data_source"),
        F.col("o_orderkey").alias("claim_number"),
        F.col("o_orderpriority").alias("lob"),
        F.to_date("o_orderdate").alias("claim_loss_date"),
        F.to_date("o_orderdate").alias("claim_notification_date"),
        F.col("o_orderstatus").alias("claim_status"),
        F.col("o_totalprice").alias("total_excess"),
        F.col("o_custkey").alias("insured_liability_position_value"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as payments; grouping/description from part, line of business
    from the order.  ``transaction_type`` is the line number as text with line 7
    made NULL, so the equals-or-NULL predicate has NULLs to keep."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag",
        "l_linestatus", "l_shipdate")
    pt = table(spark, sf_dir, "part")
    od = table(spark, sf_dir, "orders")
    # Enrichment joins are LEFT joins: a payment is never dropped for a
    # missing dimension row, and an aggregate that reads only line columns
    # with a duplicate-agnostic function (the latest-date max) lets Catalyst
    # remove both joins from that branch.
    j = (li.join(pt, li.l_partkey == pt.p_partkey, "left")
         .join(od, li.l_orderkey == od.o_orderkey, "left"))
    return j.select(
        F.lit(SOURCE_TAG).alias("data_source"),
        F.col("l_orderkey").alias("claim_number"),
        F.col("l_suppkey").alias("claimant_number"),
        F.col("o_orderpriority").alias("lob"),
        F.to_date("l_shipdate").alias("payment_date"),
        F.col("p_name").alias("payee_name"),
        F.col("l_returnflag").alias("section"),
        F.col("l_linestatus").alias("clean_payment_status"),
        F.expr("nullif(cast(l_linenumber AS string), '7')").alias("transaction_type"),
        F.col("p_type").alias("payment_grouping1"),
        F.col("p_brand").alias("payment_desc"),
        F.col("l_extendedprice").alias("payment_amount"),
    )


def line_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment columns that need no part: key, line of business, section,
    status and amount.  (A LEFT join below a sum cannot be removed by the
    optimizer, so flows that read no part column do not join it.)"""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    od = table(spark, sf_dir, "orders")
    return li.join(od, li.l_orderkey == od.o_orderkey, "left").select(
        F.col("l_orderkey").alias("claim_number"), F.col("o_orderpriority").alias("lob"),
        F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("clean_payment_status"),
        F.col("l_extendedprice").alias("payment_amount"))


def claimants(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Distinct (order, supplier) line attributes joined to the supplier and
    its region.  A pair with several lines can yield several claimant rows,
    so the spine join really fans out.

    The line-derived columns are de-duplicated before the dimension joins:
    every supplier-derived column is a function of the (unique) supplier key,
    so the rows are the same as de-duplicating the joined rows, and the
    aggregate carries five narrow columns instead of fourteen."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    if only is not None:   # restrict to the claims of ``only`` before the distinct
        li = li.join(only, li.l_orderkey == only.claim_number, "left_semi")
    lines = li.select(
        F.col("l_orderkey").alias("claim_number"),
        F.col("l_suppkey").alias("claimant_number"),
        F.col("l_quantity").cast("string").alias("speed_at_impact"),
        F.expr("cast(l_linestatus = 'F' AS string)").alias("is_vehicle_parked"),
        F.expr("CASE WHEN l_returnflag = 'N' THEN 'Yes' ELSE 'No' END").alias("can_vehicle_be_driven"),
        F.expr("nullif(l_returnflag, 'A')").alias("total_loss_vehicle"),
    ).distinct()
    su = table(spark, sf_dir, "supplier")
    na = table(spark, sf_dir, "nation")
    rg = table(spark, sf_dir, "region")
    j = (lines.join(su, lines.claimant_number == su.s_suppkey)
         .join(na, su.s_nationkey == na.n_nationkey)
         .join(rg, na.n_regionkey == rg.r_regionkey))
    return j.select(
        "claim_number", "claimant_number",
        F.lit(SOURCE_TAG).alias("data_source"),
        F.col("r_name").alias("claimant_type"),
        F.col("s_name").alias("loss_type"),
        F.col("n_name").alias("incident_severity_desc"),
        "speed_at_impact",
        F.expr("cast(s_acctbal > 5000 AS string)").alias("is_injured"),
        "is_vehicle_parked",
        F.expr("cast(s_nationkey % 2 = 0 AS string)").alias("is_passenger"),
        F.col("s_acctbal").alias("insured_vehicle_value"),
        "can_vehicle_be_driven", "total_loss_vehicle",
        (F.lit(1990) + F.col("s_nationkey")).alias("vehicle_manufacture_year"),
    )


@dataclass(frozen=True)
class Binding:
    """Parameter values that make the operators meaningful on these tables."""
    paid: PaidFilter = PaidFilter(section="R", status="F", transaction_type="1")
    rules: CategoryRules = CategoryRules(
        our_legal_groups=("PROMO",),
        psla_groups=("LARGE",),
        claimant_legal_groups=("SMALL",),
        medical_descs=("Brand#1", "Brand#2", "Brand#3"),
        claimant_cost_descs=("Brand#4",),
        hospital_descs=("Brand#5", "Brand#6", "Brand#7", "Brand#8", "Brand#9"),
        special_groups=("MEDIUM",),
    )
    lobs: tuple = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
    closed_status: str = "F"
    third_party: str = "EUROPE"
    since: str = "1996-01-01"


BINDING = Binding()

SPINE_COLUMNS = ("data_source", "claim_number", "lob", "claim_loss_date", "claim_notification_date",
                 "claim_status", "total_excess")
CLAIMANT_COLUMNS = ("claim_number", "claimant_number", "data_source", "claimant_type", "loss_type",
                    "incident_severity_desc", "speed_at_impact", "is_injured", "is_vehicle_parked",
                    "is_passenger", "insured_vehicle_value", "incident_severity_desc",
                    "can_vehicle_be_driven", "total_loss_vehicle", "claimant_type",
                    "vehicle_manufacture_year")
