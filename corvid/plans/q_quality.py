"""Profiling, snapshot and row-selection queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions.columns import mix_hash, mix_hash_sql
from corvid.operators import quality
from corvid.plans import bindings as b
from corvid.plans import claims_flow as flow
from corvid.plans import oracle as o
from corvid.plans.catalog import register
from corvid.sources import latest_snapshot

SAMPLE_SEED = 101


@register("date_bounds", o.with_(o.CLAIMS, o.SPINE) + """
SELECT min(claim_notification_date) AS min_claim_notification_date,
       max(claim_notification_date) AS max_claim_notification_date FROM spine""")
def date_bounds(spark, d):
    """AG8 / DQ4 on the claim spine."""
    return quality.bounds(flow.claim_spine(spark, d), "claim_notification_date")


def sparse_customers(spark, d):
    """customer with NULLs injected at several rates: none, ~10 %, ~20 %,
    ~99.5 %, all."""
    c = b.table(spark, d, "customer")
    return c.select(
        "c_custkey", "c_nationkey",
        F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END").alias("c_acctbal"),
        F.expr("nullif(c_mktsegment, 'HOUSEHOLD')").alias("c_mktsegment"),
        F.expr("CASE WHEN c_acctbal > 9950 THEN c_name END").alias("c_name"),
        F.lit(None).cast("string").alias("c_comment"))


SPARSE_SQL = """sparse AS (
  SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
         nullif(c_mktsegment, 'HOUSEHOLD') AS c_mktsegment,
         CASE WHEN c_acctbal > 9950 THEN c_name END AS c_name,
         CAST(NULL AS VARCHAR) AS c_comment
  FROM customer)"""

_SPARSE_COLS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "c_name", "c_comment"]


@register("null_profile", f"WITH {SPARSE_SQL} SELECT count(*) AS _rows, " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _SPARSE_COLS) + " FROM sparse")
def null_profile(spark, d):
    """AG10: NULL counts of every column and the row count in one pass."""
    return quality.null_profile(sparse_customers(spark, d))


@register("null_columns_dropped", f"""WITH {SPARSE_SQL}
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM sparse""")
def null_columns_dropped(spark, d):
    """DQ1 with limit 0.99: columns at least 99 % NULL are dropped (here the
    all-NULL column and the one kept for ~0.5 % of rows)."""
    return quality.drop_null_columns(sparse_customers(spark, d), 0.99)


@register("fanout_check", o.with_(o.CLAIMS, o.CLAIMANTS, o.SPINE, o.SPINE2) + """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(max(n) AS BIGINT) AS max_rows_per_key
FROM (SELECT claim_number, data_source, count(*) AS n FROM spine2 GROUP BY ALL)""")
def fanout_check(spark, d):
    """DQ3 + AG9 on the claimant spine."""
    return quality.fanout_check(flow.spine_with_claimants(spark, d), ["claim_number", "data_source"])


@register("latest_snapshot", """
SELECT *, CAST(ts AS DATE) AS load_date FROM events
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def latest_snapshot_q(spark, d):
    """SC4: rows of the newest load (load date = event day)."""
    ev = b.table(spark, d, "events").withColumn("load_date", F.to_date("ts"))
    return latest_snapshot(ev, "load_date")


@register("head_rows", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def head_rows(spark, d):
    """SO4: first five rows by key."""
    docs = b.table(spark, d, "documents")
    return docs.select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(5)


@register("sample_row", f"""
SELECT doc_id, lang, source, n_chars FROM documents
ORDER BY {mix_hash_sql('doc_id', SAMPLE_SEED)}, doc_id LIMIT 1""")
def sample_row(spark, d):
    """SO5: one row drawn by a seeded portable hash."""
    docs = b.table(spark, d, "documents")
    return (docs.select("doc_id", "lang", "source", "n_chars")
            .orderBy(mix_hash("doc_id", SAMPLE_SEED), "doc_id").limit(1))
