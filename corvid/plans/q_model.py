"""Matrix, folds and model-score queries with their SQL oracles."""

from __future__ import annotations

from corvid.functions.columns import mix_hash_sql
from corvid.plans import model_flow as mf
from corvid.plans import oracle_text as ot
from corvid.plans import text_flow as tf
from corvid.plans.catalog import register

FEATS = list(mf.MATRIX_FEATURES)


def matrix_sql() -> str:
    cols = ", ".join(f"coalesce(try_cast({c} AS DOUBLE), 0) AS {c}" for c in FEATS)
    return f"""
SELECT b.doc_id, {cols}, coalesce(try_cast(b.toxic AS DOUBLE), 0) AS toxic
FROM (SELECT l.doc_id, d.n_chars, l.quality, d.source, l.toxic
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id) b
JOIN ({ot.token_sql(tf.TEST_TOKENS)}) t ON b.doc_id = t.doc_id
JOIN ({ot.phrase_sql(tf.TEST_PHRASES)}) p ON b.doc_id = p.doc_id"""


def folds_sql(rows: str = "SELECT doc_id, toxic FROM labels", key: str = "doc_id", label: str = "toxic") -> str:
    return f"""
WITH l AS ({rows}),
cls AS (SELECT {label}, count(*) AS n, min({key}) AS first FROM l GROUP BY {label}),
enc AS (SELECT {label}, n, coalesce(sum(n) OVER (ORDER BY first
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cls),
fo AS (SELECT range AS f FROM range(5)),
alloc AS (
  SELECT e.{label}, fo.f,
    (CASE WHEN e.start + e.n - 1 - fo.f < 0 THEN 0 ELSE floor((e.start + e.n - 1 - fo.f) / 5) + 1 END)
  - (CASE WHEN e.start - 1 - fo.f < 0 THEN 0 ELSE floor((e.start - 1 - fo.f) / 5) + 1 END) AS a
  FROM enc e CROSS JOIN fo),
cum AS (SELECT {label}, f, sum(a) OVER (PARTITION BY {label} ORDER BY f) AS hi,
               sum(a) OVER (PARTITION BY {label} ORDER BY f) - a AS lo FROM alloc),
r AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {key}) - 1 AS rk FROM l)
SELECT r.{key}, r.{label}, CAST(c.f AS INTEGER) AS fold
FROM r JOIN cum c ON r.{label} = c.{label} AND r.rk >= c.lo AND r.rk < c.hi"""


FOLDS_SQL = folds_sql()


def gnb_sql(tail: str, matrix: str | None = None, folds: str = FOLDS_SQL, feats=None, label: str = "toxic",
            key: str = "doc_id") -> str:
    """Gaussian naive Bayes in closed form: per training split, class priors,
    means and population variances, variance floor 1e-9 x the largest
    feature variance of the split; predict the most likely class (ties ->
    the lower class)."""
    feats = list(feats or FEATS)
    stats = ", ".join(f"avg({x}) AS mu_{x}, var_pop({x}) AS v_{x}" for x in feats)
    maxvar = "greatest(" + ", ".join(f"var_pop({x})" for x in feats) + ")"
    terms = " + ".join(
        f"ln(2 * pi() * (s.v_{x} + 1e-9 * t.maxvar)) + "
        f"(d.{x} - s.mu_{x}) * (d.{x} - s.mu_{x}) / (s.v_{x} + 1e-9 * t.maxvar)" for x in feats)
    return f"""
WITH m AS ({matrix or matrix_sql()}),
f AS ({folds}),
data AS (SELECT m.*, f.fold FROM m JOIN f ON m.{key} = f.{key}),
train AS (SELECT fo.fold AS test_fold, d.* FROM (SELECT DISTINCT fold FROM data) fo
          JOIN data d ON d.fold <> fo.fold),
stats AS (SELECT test_fold, {label} AS cls, count(*) AS n_c, {stats} FROM train GROUP BY test_fold, {label}),
tot AS (SELECT test_fold, count(*) AS n, {maxvar} AS maxvar FROM train GROUP BY test_fold),
scored AS (
  SELECT d.{key}, d.fold, d.{label}, s.cls,
         ln(s.n_c / t.n) - 0.5 * ({terms}) AS ll
  FROM data d JOIN stats s ON s.test_fold = d.fold JOIN tot t ON t.test_fold = d.fold),
pred AS (
  SELECT {key}, fold, {label} AS label, cls AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ll DESC, cls) AS rn FROM scored)
  WHERE rn = 1),
conf AS (
  SELECT 'Gaussian Naive Bayes' AS model, fold,
         count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
  FROM pred GROUP BY fold)
{tail}"""


def _r(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END"


SCORES_TAIL = f""", per_fold AS (
  SELECT model, fold, {_r('tp + tn', 'tp + fp + fn + tn')} AS acc, {_r('tp', 'tp + fp')} AS prec,
         {_r('tp', 'tp + fn')} AS rec, {_r('2 * tp', '2 * tp + fp + fn')} AS f1 FROM conf)
SELECT model, metric, round(score, 12) AS score FROM (
  SELECT model, 'Accuracy' AS metric, avg(acc) AS score FROM per_fold GROUP BY model
  UNION ALL SELECT model, 'Precision', avg(prec) FROM per_fold GROUP BY model
  UNION ALL SELECT model, 'Recall', avg(rec) FROM per_fold GROUP BY model
  UNION ALL SELECT model, 'F1 Score', avg(f1) FROM per_fold GROUP BY model)"""


def _draws(seed: int) -> str:
    """CTEs after m (minority rows: id, r), cnt (n_min, need) and nn (id, nbr, rank): one row per synthetic sample."""
    return f"""
alloc AS (SELECT m.id, m.r, c.n_min, c.need // c.n_min + CASE WHEN m.r < c.need % c.n_min THEN 1 ELSE 0 END AS m_r FROM m, cnt c),
samples AS (SELECT id, r + n_min * t AS s FROM alloc, LATERAL (SELECT unnest(range(m_r)) AS t)),
draws AS (SELECT id, s, ((({mix_hash_sql('s', seed)}) * 5) >> 32) + 1 AS pick,
                 CAST({mix_hash_sql('s', seed, 1)} AS DOUBLE) / {float(1 << 32)} AS u FROM samples),
picked AS (SELECT d.id, d.s, d.u, nn.nbr FROM draws d JOIN nn ON nn.id = d.id AND nn.rank = d.pick)"""


def _minority(ratio: float) -> str:
    return f"""mtx AS ({matrix_sql()}),
cls AS (SELECT toxic, count(*) AS n FROM mtx GROUP BY toxic),
small AS (SELECT toxic FROM cls ORDER BY n, toxic LIMIT 1),
cnt AS (SELECT min(n) AS n_min, CAST(floor({ratio} * max(n) - min(n)) AS BIGINT) AS need FROM cls),
m AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS r, * EXCLUDE (doc_id, toxic) FROM mtx
      WHERE toxic = (SELECT toxic FROM small))"""


def smote_sql() -> str:
    """The matrix oversampled 1:1: ord (row order), features, toxic."""
    dist = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in FEATS)
    made = ", ".join(f"a.{x} + p.u * (b.{x} - a.{x}) AS {x}" for x in FEATS)
    return f"""WITH {_minority(mf.SMOTE['ratio'])},
nn AS (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank
       FROM (SELECT a.id, b.id AS nbr, sqrt({dist}) AS dist FROM m a JOIN m b ON a.id <> b.id)),
{_draws(mf.SMOTE['seed'])}
SELECT doc_id AS ord, {", ".join(FEATS)}, toxic FROM mtx
UNION ALL SELECT (SELECT max(doc_id) + 1 FROM mtx) + p.s, {made}, (SELECT toxic FROM small)
FROM picked p JOIN m a ON a.id = p.id JOIN m b ON b.id = p.nbr"""


def smotenc_sql() -> str:
    """The matrix oversampled with mixed types: doc_id, features, toxic, synthetic, sample."""
    cont, cat = mf.NC_CONTINUOUS, mf.NC_CATEGORICAL
    dist = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in cont)
    differ = " + ".join(f"CASE WHEN a.{x} IS DISTINCT FROM b.{x} THEN 1 ELSE 0 END" for x in cat)
    votes = " UNION ALL ".join(f"SELECT nn.id, '{x}' AS col, b.{x} AS v FROM nn JOIN m b ON b.id = nn.nbr" for x in cat)
    modes = ", ".join(f"max(CASE WHEN col = '{x}' THEN v END) AS {x}" for x in cat)
    made = ", ".join(f"a.{x} + p.u * (b.{x} - a.{x}) AS {x}" if x in cont else f"o.{x}" for x in FEATS)
    sds = ", ".join(f"stddev_pop({x})" for x in cont)
    return f"""WITH {_minority(mf.SMOTE_NC['ratio'])},
w AS (SELECT list_sort([{sds}])[{len(cont) // 2 + 1}] AS med FROM m),
nn AS (SELECT * FROM (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank
       FROM (SELECT a.id, b.id AS nbr, sqrt({dist} + ({differ}) * (w.med * w.med / 2)) AS dist FROM w, m a JOIN m b ON a.id <> b.id))
       WHERE rank <= 5),
votes AS ({votes}),
modes AS (SELECT id, {modes} FROM (
            SELECT id, col, v, row_number() OVER (PARTITION BY id, col ORDER BY count(*) DESC, v) AS rn FROM votes GROUP BY id, col, v)
          WHERE rn = 1 GROUP BY id),
{_draws(mf.SMOTE_NC['seed'])}
SELECT doc_id, {", ".join(FEATS)}, toxic, false AS synthetic, CAST(NULL AS BIGINT) AS sample FROM mtx
UNION ALL SELECT NULL, {made}, (SELECT toxic FROM small), true, CAST(p.s AS BIGINT)
FROM picked p JOIN m a ON a.id = p.id JOIN m b ON b.id = p.nbr JOIN modes o ON o.id = p.id"""


def _balanced_gnb(rows: str) -> str:
    return gnb_sql(SCORES_TAIL, rows, folds_sql(f"SELECT ord, toxic FROM ({rows})", "ord"), key="ord")


def gnb_smote_sql() -> str:
    return _balanced_gnb(smote_sql())


def gnb_smotenc_sql() -> str:
    return _balanced_gnb(f"""SELECT CASE WHEN synthetic THEN max(doc_id) OVER () + 1 + sample ELSE doc_id END AS ord, {", ".join(FEATS)}, toxic
FROM ({smotenc_sql()})""")


def best_model_sql() -> str:
    sets = (("Plain", gnb_sql(SCORES_TAIL)), ("Oversampled", gnb_smote_sql()), ("Mixed-type oversampled", gnb_smotenc_sql()))
    long = " UNION ALL ".join(f"SELECT {k} AS place, '{n}' AS model, metric, score FROM ({q})" for k, (n, q) in enumerate(sets))
    wide = ", ".join(f"max(CASE WHEN model = '{n}' THEN score END) AS \"{n}\"" for n, _ in sets)
    return f"""WITH l AS ({long})
SELECT metric, {wide}, (SELECT model FROM l x WHERE x.metric = l.metric ORDER BY score DESC, place LIMIT 1) AS "Best Score"
FROM l GROUP BY metric"""


@register("numeric_matrix", matrix_sql())
def numeric_matrix(spark, d):
    """FM1 + FN8 over labelled documents with token and phrase features."""
    return mf.matrix(spark, d)


@register("stratified_folds", FOLDS_SQL)
def stratified_folds(spark, d):
    """WN5: stratified 5-fold numbers in data order."""
    return mf.folds(spark, d)


@register("class_sizes", "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic")
def class_sizes(spark, d):
    """AG14/AG15/FL10."""
    return mf.class_sizes(spark, d)


@register("gnb_confusion", gnb_sql("SELECT * FROM conf"))
def gnb_confusion(spark, d):
    """ML8 + AG16 per fold."""
    return mf.gnb_confusion(spark, d)


@register("gnb_scores", gnb_sql(SCORES_TAIL))
def gnb_scores(spark, d):
    """ML8 + AG16 + AG17."""
    return mf.gnb_scores(spark, d)


@register("model_scores")
def model_scores(spark, d):
    """ML1 + ML3-ML12 + AG16-AG19: matrix oversampled 1:1, 5-fold scores of
    every learner, as the table (metric x model, best model)."""
    return mf.model_scores(spark, d, balance="global")[1]


@register("model_scores_nc")
def model_scores_nc(spark, d):
    """ML2 + ML13: the same evaluation on the mixed-type oversampled set."""
    return mf.model_scores(spark, d, balance="global_nc")[1]


@register("smotenc_rows", smotenc_sql)
def smotenc_rows(spark, d):
    """ML2: the mixed-type oversampled rows themselves."""
    return mf.smotenc_rows(spark, d)


@register("gnb_scores_smote", gnb_smote_sql)
def gnb_scores_smote(spark, d):
    """ML1 + ML3 + ML8 on the set oversampled 1:1."""
    return mf.gnb_scores_smote(spark, d)


@register("gnb_scores_smotenc", gnb_smotenc_sql)
def gnb_scores_smotenc(spark, d):
    """ML2 + ML8 + ML13 on the mixed-type oversampled set."""
    return mf.gnb_scores_smotenc(spark, d)


@register("best_model", best_model_sql)
def best_model(spark, d):
    """AG18 + AG19: score table and best variant per metric."""
    return mf.best_model(spark, d)
