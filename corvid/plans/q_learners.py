"""Learners fitted by Spark aggregates: exact tree, squared-hinge classifier and boosting, with SQL that fits them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import boosting as bo
from corvid.operators import evaluate as ev
from corvid.operators import linear, trees
from corvid.plans import model_flow as mf
from corvid.plans.catalog import register
from corvid.plans.q_model import FEATS, FOLDS_SQL, matrix_sql

DEPTH = 4
D = len(FEATS)

_DATA = f"""
mtx AS MATERIALIZED ({matrix_sql()}),
folds AS MATERIALIZED ({FOLDS_SQL}),
data AS MATERIALIZED (SELECT mtx.*, folds.fold, CAST(mtx.toxic AS INTEGER) AS y FROM mtx JOIN folds ON mtx.doc_id = folds.doc_id)"""


def _data(spark: SparkSession, d: str) -> DataFrame:
    return mf.matrix(spark, d).join(mf.folds(spark, d).select(mf.ID, "fold"), mf.ID)


# -- exact tree -----------------------------------------------------------------

def tree_sql(depth: int = DEPTH) -> str:
    """Every level grown again by windows over all values; node 1 is the root."""
    half = lambda n, k: f"(CAST({k} AS DOUBLE) * CAST({n} - {k} AS DOUBLE)) / CAST({n} AS DOUBLE)"
    steps = []
    for k in range(depth):
        steps.append(f"""
cut{k} AS MATERIALIZED (
  SELECT node, feature, value, n, sum(n) OVER up AS l, sum(n1) OVER up AS l1, sum(n) OVER al AS a, sum(n1) OVER al AS a1, lead(value) OVER o AS nxt
  FROM (SELECT node, feature, value, count(*) AS n, sum(y) AS n1 FROM st{k} JOIN vals USING (doc_id) WHERE fold <> 0 GROUP BY ALL)
  WINDOW o AS (PARTITION BY node, feature ORDER BY value), al AS (PARTITION BY node, feature),
         up AS (PARTITION BY node, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best{k} AS MATERIALIZED (
  SELECT node, feature, threshold FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY impurity, feature, threshold) AS rn FROM (
      SELECT node, feature, {half('l', 'l1')} + {half('(a - l)', '(a1 - l1)')} AS impurity,
             CASE WHEN value / 2 + nxt / 2 < nxt THEN value / 2 + nxt / 2 ELSE value END AS threshold
      FROM cut{k} WHERE nxt IS NOT NULL AND a1 > 0 AND a1 < a))
  WHERE rn = 1),
st{k + 1} AS MATERIALIZED (
  SELECT s.doc_id, s.fold, s.y, CASE WHEN b.node IS NULL THEN s.node ELSE 2 * s.node + CAST(v.value > b.threshold AS INTEGER) END AS node
  FROM st{k} s LEFT JOIN best{k} b ON b.node = s.node LEFT JOIN vals v ON v.doc_id = s.doc_id AND v.feature = b.feature)""")
    return f"""WITH {_DATA},
vals AS MATERIALIZED (SELECT doc_id, unnest(range({D})) AS feature, unnest([{", ".join(FEATS)}]) AS value FROM data),
st0 AS MATERIALIZED (SELECT doc_id, fold, y, CAST(1 AS BIGINT) AS node FROM data),{",".join(steps)},
leaves AS (SELECT node, CAST(2 * sum(y) > count(*) AS DOUBLE) AS prediction FROM st{depth} WHERE fold <> 0 GROUP BY node)
SELECT s.doc_id, s.fold, s.node, l.prediction FROM st{depth} s LEFT JOIN leaves l ON l.node = s.node"""


@register("tree_predictions", tree_sql)
def tree_predictions(spark, d):
    """ML6: an exact-threshold tree of four levels fitted on folds 1 to 4; leaf and prediction of every row."""
    rows = _data(spark, d).select(mf.ID, "fold", F.array(*FEATS).alias("x"), mf.LABEL).checkpoint()
    tree = trees.fit_tree(rows.where("fold <> 0"), "x", mf.LABEL, DEPTH)
    return trees.tree_leaves(rows, "x", tree).select(mf.ID, "fold", "node", "prediction")


# -- squared-hinge classifier -----------------------------------------------------

def svc_sql(c: float = 1.0, steps: int = 30) -> str:
    """Newton steps for the five training splits at once; each step's equations are solved by elimination, a variable a select."""
    n = D + 1
    xs = [f"(({f}) - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1) AS x{i}" for i, f in enumerate(FEATS)] + [f"1.0 AS x{D}"]
    ws = [f"w{i}" for i in range(n)]
    slack = f"1 - s * ({' + '.join(f'w{i} * x{i}' for i in range(n))})"
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    a = [f"{float(i == j)} + {2 * c} * sum(CASE WHEN slack > 0 THEN x{i} * x{j} ELSE 0 END) AS a{i}_{j}" for i, j in pairs]
    b = [f"w{i} - {2 * c} * sum(CASE WHEN slack > 0 THEN s * slack * x{i} ELSE 0 END) AS b{i}" for i in range(n)]
    q = f"SELECT split, it, {', '.join(ws)}, {', '.join(a + b)} FROM (SELECT nw.*, x.*, {slack} AS slack FROM nw JOIN x ON x.fold <> nw.split WHERE it < {steps}) GROUP BY split, it, {', '.join(ws)}"
    for k in range(n - 1):
        new = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i, j in pairs if i > k] + [f"b{i} - a{k}_{i} * b{k} / a{k}_{k} AS b{i}" for i in range(k + 1, n)]
        old = [f"a{i}_{j}" for i, j in pairs if i <= k] + [f"b{i}" for i in range(k + 1)]
        q = f"SELECT split, it, {', '.join(ws + old + new)} FROM ({q})"
    for k in range(n - 1, -1, -1):
        known = "".join(f" - a{k}_{j} * d{j}" for j in range(k + 1, n))
        q = f"SELECT *, (b{k}{known}) / a{k}_{k} AS d{k} FROM ({q})"
    return f"""WITH RECURSIVE {_DATA},
x AS MATERIALIZED (SELECT doc_id, fold, y, 2.0 * y - 1 AS s, {", ".join(xs)} FROM data),
nw AS (
  SELECT DISTINCT fold AS split, 0 AS it, {", ".join(f"CAST(0 AS DOUBLE) AS {w}" for w in ws)} FROM x
  UNION ALL SELECT split, it + 1, {", ".join(f"w{i} - d{i}" for i in range(n))} FROM ({q})),
done AS MATERIALIZED (SELECT * FROM nw WHERE it = {steps}),
scored AS (SELECT split, x.fold, y, {slack} AS slack, s * (1 - ({slack})) > 0 AS positive, {" + ".join(f"w{i} * w{i}" for i in range(n))} AS norm FROM done JOIN x ON true)
SELECT split AS fold, round(max(norm) / 2 + {c} * sum(CASE WHEN fold <> split AND slack > 0 THEN slack * slack ELSE 0 END), 6) AS objective,
       count(*) FILTER (WHERE fold = split AND y = 1 AND positive) AS tp, count(*) FILTER (WHERE fold = split AND y = 0 AND positive) AS fp,
       count(*) FILTER (WHERE fold = split AND y = 1 AND NOT positive) AS fn, count(*) FILTER (WHERE fold = split AND y = 0 AND NOT positive) AS tn
FROM scored GROUP BY split"""


@register("svc_scores", svc_sql)
def svc_scores(spark, d):
    """ML5: squared-hinge classifier on standardised features, per held-out fold: objective at the optimum and confusion counts."""
    rows = linear.standardised(_data(spark, d), FEATS).select("fold", F.array(*FEATS).alias("x"), F.col(mf.LABEL).alias("label")).checkpoint()
    out = None
    for f in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):
        model = linear.fit_svc(rows.where(F.col("fold") != f), "x", "label")
        test = rows.where(F.col("fold") == f).withColumn("prediction", (model.margin("x") > 0).cast("double"))
        part = ev.confusion(test, ["fold"]).withColumn("objective", F.lit(round(model.objective, 6)))
        out = part if out is None else out.unionByName(part)
    return out.select("fold", "objective", "tp", "fp", "fn", "tn")


# -- boosting ---------------------------------------------------------------------

#: A number is missing in these rows, so that cuts have a side to learn for them.
MISSING = "n_chars % 4 = 3"
ROUNDS = 2
SECOND_ORDER = bo.preset(bo.SECOND_ORDER, rounds=ROUNDS, max_depth=3)
HISTOGRAM = bo.preset(bo.HISTOGRAM, rounds=ROUNDS, max_depth=3, max_bins=16)
LEAF_WISE = bo.preset(bo.LEAF_WISE, rounds=ROUNDS, max_leaves=5, max_bins=32)


def boost_sql(p: bo.Boosting) -> str:
    """Bins, and every cut of every tree, found again."""
    u = repr(bo.UNIT)
    value = lambda f: f"CASE WHEN {MISSING} THEN NULL ELSE {f} END" if f == "n_chars" else f
    score = lambda g, h: f"(CAST({g} AS DOUBLE) * CAST({g} AS DOUBLE) / (CAST({h} AS DOUBLE) + {p.l2} * {u}))"
    enough = lambda n, h: f"{n} >= {max(1, p.min_rows)} AND {h} >= {p.min_hessian} * {u} AND {h} > 0"
    start = "ln(CAST(sum(y) FILTER (WHERE fold <> 0) OVER () AS DOUBLE) / (count(*) FILTER (WHERE fold <> 0) OVER () - sum(y) FILTER (WHERE fold <> 0) OVER ()))" if p.prior else "0.0"
    ctes = []
    for r in range(p.rounds):
        ctes.append(f"""
g{r}_0 AS MATERIALIZED (
  SELECT doc_id, fold, y, margin, CAST(round_even((p - y) * {u}, 0) AS BIGINT) AS g, CAST(round_even(p * (1 - p) * {u}, 0) AS BIGINT) AS h, 1 AS node
  FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM s{r}))""")
        steps = p.max_depth if p.max_leaves is None else p.max_leaves - 1
        for k in range(steps):
            t = f"{r}_{k}"
            one = "" if p.max_leaves is None else "WHERE place = 1"
            left, right = ("2 * s.node", "2 * s.node + 1") if p.max_leaves is None else (str(2 + 2 * k), str(3 + 2 * k))
            ctes.append(f"""
c{t} AS MATERIALIZED (
  SELECT node, feature, bin, sum(g) OVER up AS g, sum(h) OVER up AS h, sum(n) OVER up AS n,
         sum(g) FILTER (WHERE bin = 0) OVER al AS gm, sum(h) FILTER (WHERE bin = 0) OVER al AS hm, sum(n) FILTER (WHERE bin = 0) OVER al AS nm,
         sum(g) OVER al AS ga, sum(h) OVER al AS ha, sum(n) OVER al AS na
  FROM (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM g{t} JOIN bins USING (doc_id) WHERE fold <> 0 GROUP BY ALL)
  WINDOW al AS (PARTITION BY node, feature), up AS (PARTITION BY node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k{t} AS MATERIALIZED (
  SELECT node, feature, bin, ml, g - (1 - ml) * coalesce(gm, 0) AS lg, h - (1 - ml) * coalesce(hm, 0) AS lh, n - (1 - ml) * coalesce(nm, 0) AS ln, ga, ha, na
  FROM c{t}, (VALUES (0), (1)) v(ml) WHERE bin > 0),
b{t} AS MATERIALIZED (
  SELECT * FROM (
    SELECT node, feature, bin, ml, row_number() OVER (ORDER BY gain DESC, node) AS place FROM (
      SELECT *, {score('lg', 'lh')} + {score('(ga - lg)', '(ha - lh)')} - {score('ga', 'ha')} AS gain FROM k{t}
      WHERE {enough('ln', 'lh')} AND {enough('(na - ln)', '(ha - lh)')})
    WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, ml) = 1)
  {one}),
g{r}_{k + 1} AS MATERIALIZED (
  SELECT s.doc_id, s.fold, s.y, s.margin, s.g, s.h,
         CASE WHEN b.node IS NULL THEN s.node WHEN CASE WHEN x.bin = 0 THEN b.ml = 1 ELSE x.bin <= b.bin END THEN {left} ELSE {right} END AS node
  FROM g{t} s LEFT JOIN b{t} b ON b.node = s.node LEFT JOIN bins x ON x.doc_id = s.doc_id AND x.feature = b.feature)""")
        last = f"g{r}_{steps}"
        ctes.append(f"""
v{r} AS (SELECT node, {p.rate} * (-CAST(sum(g) AS DOUBLE) / (CAST(sum(h) AS DOUBLE) + {p.l2} * {u})) AS value FROM {last} WHERE fold <> 0 GROUP BY node),
s{r + 1} AS MATERIALIZED (SELECT doc_id, fold, y, margin + coalesce(value, 0) AS margin FROM {last} LEFT JOIN v{r} USING (node))""")
    return f"""WITH {_DATA},
vals AS MATERIALIZED (SELECT doc_id, fold, unnest(range({D})) AS feature, unnest([{", ".join(value(f) for f in FEATS)}]) AS value FROM data),
cells AS (SELECT feature, value, count(*) AS n FROM vals WHERE fold <> 0 AND value IS NOT NULL GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY value) AS upto, sum(n) OVER (PARTITION BY feature) AS al, count(*) OVER (PARTITION BY feature) AS nv,
               lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt FROM cells),
edges AS MATERIALIZED (SELECT feature, value / 2 + nxt / 2 AS edge FROM cum
  WHERE nxt IS NOT NULL AND (nv <= {p.max_bins} OR upto * {p.max_bins} // al > (upto - n) * {p.max_bins} // al)),
bins AS MATERIALIZED (
  SELECT v.doc_id, v.feature, CASE WHEN v.value IS NULL THEN 0 ELSE 1 + count(e.edge) END AS bin
  FROM vals v LEFT JOIN edges e ON e.feature = v.feature AND e.edge < v.value GROUP BY v.doc_id, v.feature, v.value),
s0 AS MATERIALIZED (SELECT doc_id, fold, y, {start} AS margin FROM data),{",".join(ctes)}
SELECT doc_id, fold, round(margin, 9) AS margin, CAST(margin > 0 AS INTEGER) AS prediction FROM s{p.rounds}"""


def _boosted(spark: SparkSession, d: str, p: bo.Boosting) -> DataFrame:
    feats = [F.when(F.expr(MISSING), None).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in FEATS]
    rows = _data(spark, d).select(F.lit(0).alias("m"), F.col(mf.ID).alias("id"), (F.col("fold") != 0).alias("train"),
                                  F.col(mf.LABEL).alias("y"), F.array(*feats).alias("x"), "fold").checkpoint()
    scored, _ = bo.boost(rows, p)
    return scored.join(rows.select("id", "fold"), "id").select(
        F.col("id").alias(mf.ID), "fold", F.round("margin", 9).alias("margin"), (F.col("margin") > 0).cast("int").alias("prediction"))


@register("boost_second_order", lambda: boost_sql(SECOND_ORDER))
def boost_second_order(spark, d):
    """ML9: two rounds of second-order boosting (regularised gains, a side for missing values) on folds 1 to 4; margins of all rows."""
    return _boosted(spark, d, SECOND_ORDER)


@register("boost_histogram", lambda: boost_sql(HISTOGRAM))
def boost_histogram(spark, d):
    """ML11: two rounds on 16 quantile bins, siblings by subtraction."""
    return _boosted(spark, d, HISTOGRAM)


@register("boost_leaf_wise", lambda: boost_sql(LEAF_WISE))
def boost_leaf_wise(spark, d):
    """ML12: two rounds of trees of five leaves, the leaf with the best gain cut first."""
    return _boosted(spark, d, LEAF_WISE)
