"""ANSI SQL (DuckDB dialect) twins of the bound queries, used as oracles.

They are written from the operator definitions, in the plain form (windows,
``row_number``, CASE, conditional sums), while the Spark side uses the
skew-safe plans, so the two check each other.
"""

from __future__ import annotations

from corvid.operators.payments import CATEGORIES

# -- role bindings -------------------------------------------------------------

CLAIMS = """claims AS (
  SELECT 'tpch' AS data_source, o_orderkey AS claim_number, o_orderpriority AS lob,
         CAST(o_orderdate AS DATE) AS claim_loss_date,
         CAST(o_orderdate AS DATE) AS claim_notification_date,
         o_orderstatus AS claim_status, o_totalprice AS total_excess,
         o_custkey AS insured_liability_position_value
  FROM orders)"""

PAYMENTS = """payments AS (
  SELECT 'tpch' AS data_source, l_orderkey AS claim_number, l_suppkey AS claimant_number,
         o_orderpriority AS lob, CAST(l_shipdate AS DATE) AS payment_date, p_name AS payee_name,
         l_returnflag AS section, l_linestatus AS clean_payment_status,
         NULLIF(CAST(l_linenumber AS VARCHAR), '7') AS transaction_type,
         p_type AS payment_grouping1, p_brand AS payment_desc, l_extendedprice AS payment_amount
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey)"""

CLAIMANTS = """claimants AS (
  SELECT DISTINCT l_orderkey AS claim_number, l_suppkey AS claimant_number, 'tpch' AS data_source,
         r_name AS claimant_type, s_name AS loss_type, n_name AS incident_severity_desc,
         CAST(l_quantity AS VARCHAR) AS speed_at_impact,
         CAST(s_acctbal > 5000 AS VARCHAR) AS is_injured,
         CAST(l_linestatus = 'F' AS VARCHAR) AS is_vehicle_parked,
         CAST(s_nationkey % 2 = 0 AS VARCHAR) AS is_passenger,
         s_acctbal AS insured_vehicle_value,
         CASE WHEN l_returnflag = 'N' THEN 'Yes' ELSE 'No' END AS can_vehicle_be_driven,
         NULLIF(l_returnflag, 'A') AS total_loss_vehicle,
         1990 + s_nationkey AS vehicle_manufacture_year
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CLAIMANT_SELECT = """claim_number, data_source, claimant_number, claimant_type, loss_type,
         incident_severity_desc, speed_at_impact, is_injured, is_vehicle_parked, is_passenger,
         insured_vehicle_value, can_vehicle_be_driven, total_loss_vehicle, vehicle_manufacture_year"""

SPINE = """spine AS (
  SELECT DISTINCT data_source, claim_number, lob, claim_loss_date, claim_notification_date,
         claim_status, total_excess FROM claims)"""

SPINE2 = f"""spine2 AS (
  SELECT DISTINCT s.*, c.* EXCLUDE (claim_number, data_source)
  FROM spine s LEFT JOIN (SELECT {CLAIMANT_SELECT} FROM claimants) c
    ON s.claim_number = c.claim_number AND s.data_source = c.data_source)"""

INJURY = """injury AS (
  SELECT DISTINCT * FROM (
    SELECT p.*, CASE WHEN payment_date = max(payment_date)
                     OVER (PARTITION BY claim_number, claimant_number) THEN 1 ELSE 0 END AS "max"
    FROM payments p)
  WHERE section = 'R' AND clean_payment_status = 'F'
    AND (transaction_type = '1' OR transaction_type IS NULL))"""

CATEGORY_CASE = """CASE WHEN payment_grouping1 = 'PROMO' THEN 'ft_case_pay_our_legal_spend'
       WHEN payment_grouping1 = 'LARGE' THEN 'ft_case_pay_psla_amount'
       WHEN payment_grouping1 = 'SMALL' THEN 'ft_case_pay_claimant_legal_spend'
       WHEN payment_desc IN ('Brand#1', 'Brand#2', 'Brand#3') AND payment_amount = 216
            THEN 'ft_case_pay_claimant_legal_spend'
       WHEN payment_desc IN ('Brand#1', 'Brand#2', 'Brand#3') AND payment_amount = 780
            THEN 'ft_case_pay_claimant_legal_spend'
       WHEN payment_desc = 'Brand#4' THEN 'ft_case_pay_claimant_legal_spend'
       WHEN payment_desc IN ('Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9')
            THEN 'ft_case_pay_other_costs'
       WHEN payment_grouping1 = 'MEDIUM' THEN 'ft_case_pay_special_damages_spend'
       ELSE 'ft_case_pay_other_costs' END"""

FEAT = f"""feat AS (SELECT DISTINCT *, {CATEGORY_CASE} AS ft_payment_desc_category FROM injury)"""

PIVOT_GROUP = ("data_source, claim_number, claimant_number, lob, claim_notification_date, "
               "claim_status, section, clean_payment_status, transaction_type")


def _cat_sum(cat: str) -> str:
    return (f"sum(CASE WHEN ft_payment_desc_category = '{cat}' "
            f"THEN CAST(payment_amount AS DECIMAL(18, 6)) END)")


def _pivot_sql() -> str:
    cats = ",\n         ".join(f"{_cat_sum(k)} AS {k}" for k in CATEGORIES)
    legal = ("coalesce(ft_case_pay_our_legal_spend, 0) + coalesce(ft_case_pay_claimant_legal_spend, 0)")
    total = (legal + " + coalesce(ft_case_pay_special_damages_spend, 0)"
             " + coalesce(ft_case_pay_psla_amount, 0) + coalesce(ft_case_pay_other_costs, 0)")
    amounts = ",\n         ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in CATEGORIES)
    return f"""joined AS (
  SELECT f.data_source, f.claim_number, f.claimant_number, f.lob, s.claim_notification_date,
         s.claim_status, f.section, f.clean_payment_status, f.transaction_type,
         f.ft_payment_desc_category, f.payment_amount
  FROM spine2 s RIGHT JOIN feat f
    ON s.claim_number = f.claim_number AND s.claimant_number = f.claimant_number
   AND s.lob = f.lob AND s.data_source = f.data_source),
pivot_sums AS (
  SELECT {PIVOT_GROUP},
         {cats}
  FROM joined GROUP BY {PIVOT_GROUP}),
pivoted AS (
  SELECT {PIVOT_GROUP},
         {amounts},
         CAST({legal} AS DOUBLE) AS ft_case_pay_total_legal_spend,
         CAST({total} AS DOUBLE) AS ft_pay_total_spend
  FROM pivot_sums),
flagged AS (
  SELECT *, {flags("ft_pay_total_spend")} FROM pivoted)"""


def flags(total: str) -> str:
    return (f"CASE WHEN {total} > 100000 THEN 1 ELSE 0 END AS ft_large_loss1, "
            f"CASE WHEN {total} > 300000 THEN 1 ELSE 0 END AS ft_large_loss2, "
            f"CASE WHEN {total} > 100000 AND {total} < 300000 THEN 1 ELSE 0 END AS ft_large_loss3")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FLOW_A = (CLAIMS, PAYMENTS, CLAIMANTS, SPINE, SPINE2, INJURY, FEAT, _pivot_sql())

LOBS = "('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')"


def total_order(cols: list[str]) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in cols)


PIVOT_OUT = [c.strip() for c in PIVOT_GROUP.split(",")] + list(CATEGORIES) + [
    "ft_case_pay_total_legal_spend", "ft_pay_total_spend", "ft_large_loss1", "ft_large_loss2",
    "ft_large_loss3"]

CLOSED = f"""motor_pay AS (
  SELECT * FROM payments WHERE lob IN {LOBS} AND section = 'R' AND clean_payment_status = 'F'),
paid AS (
  SELECT claim_number, CAST(sum(CAST(payment_amount AS DECIMAL(18, 6))) AS DOUBLE) AS total_paid
  FROM motor_pay GROUP BY claim_number),
closed AS (
  SELECT c.*, coalesce(p.total_paid, 0) AS total_paid, {flags('coalesce(p.total_paid, 0)')}
  FROM (SELECT DISTINCT * FROM claims) c LEFT JOIN paid p ON c.claim_number = p.claim_number
  WHERE c.lob IN {LOBS} AND c.claim_status = 'F')"""

THIRD = f"""third AS (
  SELECT DISTINCT s.*, c.* EXCLUDE (claim_number, data_source)
  FROM closed s LEFT JOIN (SELECT {CLAIMANT_SELECT} FROM claimants
                           WHERE claimant_type = 'EUROPE') c
    ON s.claim_number = c.claim_number AND s.data_source = c.data_source)"""

THIRD_COLS = ["data_source", "lob", "claim_loss_date", "claim_notification_date", "claim_status",
              "total_excess", "insured_liability_position_value", "total_paid", "ft_large_loss1",
              "ft_large_loss2", "ft_large_loss3", "claimant_number", "claimant_type", "loss_type",
              "incident_severity_desc", "speed_at_impact", "is_injured", "is_vehicle_parked",
              "is_passenger", "insured_vehicle_value", "can_vehicle_be_driven",
              "total_loss_vehicle", "vehicle_manufacture_year"]

MASTER = f"""mst AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY claim_number ORDER BY {total_order(THIRD_COLS)}) AS rn
    FROM third) WHERE rn = 1),
master AS (
  SELECT * REPLACE (
    CASE WHEN is_injured = 'true' THEN 1 ELSE 0 END AS is_injured,
    CASE WHEN is_vehicle_parked = 'true' THEN 1 ELSE 0 END AS is_vehicle_parked,
    CASE WHEN can_vehicle_be_driven = 'Yes' THEN 1 ELSE 0 END AS can_vehicle_be_driven,
    coalesce(total_loss_vehicle, '0') AS total_loss_vehicle)
  FROM mst)"""

FLOW_B = (CLAIMS, PAYMENTS, CLAIMANTS, CLOSED, THIRD, MASTER)
