"""Neighbour and oversampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions.columns import mix_hash_sql
from corvid.operators import balance as bl
from corvid.plans import bindings as b
from corvid.plans import model_flow as mf
from corvid.plans.catalog import register

K = 5
SMOTE_SEED = 11
SMOTE_NC_SEED = 101
SMOTE_NC_RATIO = 0.2
NC_CONTINUOUS = mf.NC_CONTINUOUS
NC_CATEGORICAL = mf.NC_CATEGORICAL


def one_vs_rest(spark, d):
    """embeddings with a binary target: class 0 against the rest."""
    e = b.table(spark, d, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))


KNN_SQL = """
WITH m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0),
d AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.e, b.e) AS dist
      FROM m a JOIN m b ON a.vec_id <> b.vec_id)
SELECT id, nbr, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM d)
WHERE rank <= 5"""


@register("knn_minority", KNN_SQL)
def knn_minority(spark, d):
    """JN7 + WN4: exact 5 nearest neighbours inside the minority class."""
    pts = one_vs_rest(spark, d).filter(F.col("y") == 1)
    nn = bl.knn(pts, "vec_id", "embedding", K)
    return nn.select("id", "nbr", "rank", F.round("dist", 6).alias("dist"))


@register("knn_mixed", """
WITH m AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id AS id, b.vec_id AS nbr, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))
                                                   + CASE WHEN a.label IS DISTINCT FROM b.label THEN 0.25 ELSE 0 END) AS dist
      FROM m a JOIN m b ON a.vec_id <> b.vec_id)
SELECT id, nbr, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM d)
WHERE rank <= 5""")
def knn_mixed(spark, d):
    """JN7 + WN4: exact 5 nearest neighbours among all embeddings, in blocks of 64, another label adding a quarter to the squared distance."""
    pts = b.table(spark, d, "embeddings").select("vec_id", "embedding", F.array(F.col("label").cast("long")).alias("codes"))
    nn = bl.knn(pts, "vec_id", "embedding", K, 64, "codes", 0.25)
    return nn.select("id", "nbr", "rank", F.round("dist", 6).alias("dist"))


@register("smote_counts", """
WITH c AS (SELECT CAST(label = 0 AS INTEGER) AS y, count(*) AS n FROM embeddings GROUP BY 1)
SELECT y, CASE WHEN n = (SELECT min(n) FROM c) THEN (SELECT max(n) FROM c) ELSE n END AS n FROM c""")
def smote_counts(spark, d):
    """ML1 + ST1 + AG15: class sizes after 1:1 oversampling."""
    bal = bl.smote(one_vs_rest(spark, d), "vec_id", "embedding", "y", K, 1.0, SMOTE_SEED)
    return bal.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


SMOTE_ROWS_SQL = f"""
WITH m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
                  row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings WHERE label = 0),
cnt AS (SELECT (SELECT count(*) FROM m) AS n_min,
               (SELECT count(*) FROM embeddings WHERE label <> 0) AS n_maj),
par AS (SELECT n_min, n_maj - n_min AS need, {K} AS kk FROM cnt),
d AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.e, b.e) AS dist
      FROM m a JOIN m b ON a.vec_id <> b.vec_id),
nn AS (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM d),
alloc AS (SELECT m.vec_id, m.r, m.e, par.n_min, par.kk,
                 par.need // par.n_min + CASE WHEN m.r < par.need % par.n_min THEN 1 ELSE 0 END AS m_r
          FROM m CROSS JOIN par),
samples AS (SELECT vec_id, e, kk, r + n_min * t AS s
            FROM alloc, LATERAL (SELECT unnest(range(m_r)) AS t)),
draws AS (SELECT vec_id, e, s, ((({mix_hash_sql('s', SMOTE_SEED)}) * kk) >> 32) + 1 AS pick,
                 CAST({mix_hash_sql('s', SMOTE_SEED, 1)} AS DOUBLE) / {float(1 << 32)} AS u FROM samples),
synth AS (SELECT CAST(NULL AS BIGINT) AS vec_id,
                 list_transform(range(1, len(dr.e) + 1), lambda i: dr.e[i] + dr.u * (nb.e[i] - dr.e[i]))
                   AS embedding,
                 1 AS y, true AS synthetic, CAST(dr.s AS BIGINT) AS sample
          FROM draws dr JOIN nn ON nn.id = dr.vec_id AND nn.rank = dr.pick
               JOIN m nb ON nb.vec_id = nn.nbr)
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label = 0 AS INTEGER) AS y,
       false AS synthetic, CAST(NULL AS BIGINT) AS sample FROM embeddings
UNION ALL SELECT * FROM synth"""


@register("smote_rows", SMOTE_ROWS_SQL)
def smote_rows(spark, d):
    """ML1: the balanced rows themselves (originals + synthetic)."""
    return bl.smote(one_vs_rest(spark, d), "vec_id", "embedding", "y", K, 1.0, SMOTE_SEED)


@register("smotenc_counts", """
WITH c AS (SELECT toxic, count(*) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id
           GROUP BY toxic)
SELECT CAST(toxic AS DOUBLE) AS toxic,
       CASE WHEN n = (SELECT min(n) FROM c)
            THEN n + CAST(floor(0.2 * (SELECT max(n) FROM c) - n) AS BIGINT) ELSE n END AS n
FROM c""")
def smotenc_counts(spark, d):
    """ML2 + AG15: class sizes after mixed-type oversampling to ratio 0.2."""
    bal = bl.smote_nc(mf.matrix(spark, d), "doc_id", NC_CONTINUOUS, NC_CATEGORICAL, mf.LABEL,
                      K, SMOTE_NC_RATIO, SMOTE_NC_SEED)
    return bal.groupBy(mf.LABEL).agg(F.count(F.lit(1)).alias("n"))
