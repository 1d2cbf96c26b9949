"""Queries of the filtering operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import toxicity
from corvid.llm.decontaminate import contaminated
from corvid.llm.pii import find_pii
from corvid.llm.urls import evaluate, host_of


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.score_documents(docs, toxicity.train(docs, labels))


def _number(text: Column, salt: str) -> Column:
    """A number from 0 to 16^7 - 1 that DuckDB can compute too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text).cast("binary")), 1, 7), 16, 10).cast("int")


def _list_events(pages: DataFrame) -> DataFrame:
    """Dated entries of two lists over the hosts of the pages and their parents: listed, mostly taken off, at times listed again."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    parents = hosts.select(F.regexp_replace("key", r"^[^.]+\.", "").alias("key")).where("contains(key, '.')")
    keys = hosts.unionAll(parents).distinct().select("key", F.explode(F.array(F.lit("ads"), F.lit("spam"))).alias("list"))
    seed = F.concat("list", F.lit(":"), "key")
    day = F.date_add(F.lit("2020-01-01").cast("date"), _number(seed, "a") % 1500)
    gone = F.date_add(day, 1 + _number(seed, "b") % 700)
    back = F.date_add(gone, 1 + _number(seed, "c") % 400)
    states = F.array(F.struct(day.alias("day"), F.lit(True).alias("listed")),
                     F.when(_number(seed, "d") % 4 != 0, F.struct(gone.alias("day"), F.lit(False).alias("listed"))),
                     F.when(_number(seed, "d") % 4 == 1, F.struct(back.alias("day"), F.lit(True).alias("listed"))))
    return (keys.where(_number(seed, "e") % 3 == 0).select("list", "key", F.explode(states).alias("s"))
            .where("s is not null").select("list", "key", "s.day", "s.listed"))


def op7_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched on a day drawn from their id, against list entries drawn from their hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2020-01-01").cast("date"), _number(F.col("page_id").cast("string"), "f") % 2200)
    return evaluate(pages.withColumn("fetched", fetched), _list_events(pages))


_NUMBER = "CAST('0x' || substr(md5('{salt}' || {text}), 1, 7) AS INTEGER)"
_n = lambda salt, text="list || ':' || key": _NUMBER.format(salt=salt, text=text)
OP7_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS row, page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment,
         DATE '2020-01-01' + {_n('f', 'CAST(page_id AS VARCHAR)')} % 2200 AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT host AS key FROM p WHERE host IS NOT NULL),
keys AS (SELECT key FROM hosts UNION SELECT regexp_replace(key, '^[^.]+\.', '') FROM hosts WHERE contains(regexp_replace(key, '^[^.]+\.', ''), '.')),
k AS (SELECT list, key, {_n('a')} % 1500 AS a, {_n('b')} % 700 AS b, {_n('c')} % 400 AS c, {_n('d')} % 4 AS d
      FROM keys, (VALUES ('ads'), ('spam')) AS l(list) WHERE {_n('e')} % 3 = 0),
i AS (
  SELECT list, key, DATE '2020-01-01' + a AS since, CASE WHEN d <> 0 THEN DATE '2020-01-01' + a + 1 + b END AS until FROM k
  UNION ALL SELECT list, key, DATE '2020-01-01' + a + 1 + b + 1 + c, NULL FROM k WHERE d = 1),
parts AS (SELECT row, fetched, host, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS n FROM p WHERE host IS NOT NULL),
probes AS (
  SELECT row, fetched, array_to_string(string_split(host, '.')[n:], '.') AS key FROM parts
  UNION SELECT row, fetched, host || '/' || segment FROM p WHERE host IS NOT NULL AND segment <> ''),
hits AS (
  SELECT row, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n_rules, min(since) AS since
  FROM probes JOIN i USING (key) WHERE since <= fetched AND (until IS NULL OR fetched < until) GROUP BY row)
SELECT page_id, url, host, CAST(fetched AS DATE) AS fetched, n_rules IS NOT NULL AS blocked, coalesce(lists, '') AS lists,
       coalesce(n_rules, 0) AS n_rules, CAST(since AS DATE) AS since
FROM p LEFT JOIN hits USING (row)"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)


QUERIES = {f.__name__: f for f in (op3_pii_boosting, op6_toxicity, op7_temporal_url_filter, op8_benchmark_decontamination)}
ORACLE = {"op7_temporal_url_filter": OP7_SQL}
