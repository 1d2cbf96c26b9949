"""Exact tree, squared-hinge classifier and boosting against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import boosting as bo
from corvid.operators import linear, ranking, trees


def frame(spark, x, y, **more):
    rows = [(i, [None if v != v else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int")


def data(n=160, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(0, 0.4, n) > 0).astype(int)
    return x, y


# -- running sums -----------------------------------------------------------------

@pytest.mark.parametrize("per", [3, 10**6])
def test_running_sums(spark, per):
    rng = np.random.default_rng(1)
    rows = sorted({(None if g == 0 else int(g), float(v)) for g, v in zip(rng.integers(0, 4, 80), rng.integers(0, 30, 80))}, key=str)
    df = spark.createDataFrame([(g, v, k % 5) for k, (g, v) in enumerate(rows)], "g int, v double, n int")
    got = {(r["g"], r["v"]): (r["n_upto"], r["v_next"]) for r in ranking.running_sums(df, ["g"], "v", ["n"], per).collect()}
    n_of = {(r["g"], r["v"]): r["n"] for r in df.collect()}
    for g, v in n_of:
        mine = sorted(w for h, w in n_of if h == g)
        assert got[g, v] == (sum(n_of[g, w] for w in mine if w <= v), min((w for w in mine if w > v), default=None))
    assert len(got) == len(rows) and ranking.running_sums(df.limit(0), ["g"], "v", ["n"]).collect() == []


# -- tree ---------------------------------------------------------------------------

def plain_tree(x, y, depth, node=1):
    if depth == 0 or len(set(y)) < 2:
        return {node: None}
    best = None
    for f in range(x.shape[1]):
        values = sorted(set(x[:, f][~np.isnan(x[:, f])]))
        for a, b in zip(values, values[1:]):
            real = ~np.isnan(x[:, f])
            left, right = y[real & (x[:, f] <= a)], y[real & (x[:, f] > a)]
            if len(set(y[real])) < 2:
                continue
            half = lambda t: float(t.sum()) * float(len(t) - t.sum()) / float(len(t))
            cut = (half(left) + half(right), f, a / 2 + b / 2 if a / 2 + b / 2 < b else a)
            best = min(best or cut, cut)
    if best is None:
        return {node: None}
    _, f, t = best
    right = x[:, f] > t
    return {node: (f, t)} | plain_tree(x[~right], y[~right], depth - 1, 2 * node) | plain_tree(x[right], y[right], depth - 1, 2 * node + 1)


@pytest.mark.parametrize("per, missing", [(20, False), (10**6, True)])
def test_tree_against_plain(spark, per, missing):
    x, y = data()
    if missing:
        x[::7, 0] = np.nan
    df = frame(spark, x, y)
    tree = trees.fit_tree(df, "x", "y", 4, per)
    got = {r["node"]: (r["feature"], r["threshold"]) for s in tree.splits for r in s.collect()}
    want = plain_tree(x, y, 4)
    assert got == {n: c for n, c in want.items() if c}
    for r in trees.tree_leaves(df, "x", tree).collect():
        node = 1
        while want.get(node):
            f, t = want[node]
            v = r["x"][f]
            node = 2 * node + int(v is not None and v > t)
        assert r["node"] == node
    held = {r["node"]: (r["n"], r["n1"], r["prediction"]) for r in tree.leaves.collect()}
    assert sum(v[0] for v in held.values()) == len(y) and all(p == float(2 * k > n) for n, k, p in held.values())


def test_tree_edges(spark):
    one = frame(spark, np.zeros((5, 2)), [1, 0, 1, 1, 0])
    tree = trees.fit_tree(one, "x", "y", 3)
    assert tree.splits == () and tree.leaves.collect()[0]["prediction"] == 1.0
    empty = trees.fit_tree(one.limit(0), "x", "y", 3)
    assert empty.leaves.collect() == [] and [r["prediction"] for r in trees.tree_leaves(one, "x", empty).collect()] == [None] * 5


# -- squared hinge ------------------------------------------------------------------

def objective(w, x, y, c):
    slack = np.maximum(0, 1 - (2 * y - 1) * (x @ w))
    return 0.5 * w @ w + c * (slack ** 2).sum()


@pytest.mark.parametrize("c", [0.01, 1.0, 50.0])
def test_svc_reaches_the_optimum(spark, c):
    x, y = data(120, 3, 4)
    model = linear.fit_svc(frame(spark, x, y), "x", "y", c)
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.array(model.weights)
    assert abs(objective(w, full, y, c) - model.objective) < 1e-9 * max(1, model.objective)
    slope = [(objective(w + h, full, y, c) - objective(w - h, full, y, c)) / 2e-5 for h in np.eye(4) * 1e-5]
    assert np.abs(slope).max() < 1e-4 * max(1, c)
    rng = np.random.default_rng(0)
    assert all(objective(w + rng.normal(0, s, 4), full, y, c) >= model.objective for s in (1e-3, 1e-2, 1) for _ in range(50))
    got = [r["m"] for r in frame(spark, x, y).select("id", model.margin("x").alias("m")).orderBy("id").collect()]
    assert np.allclose(got, full @ w)


def test_svc_edges(spark):
    df = frame(spark, [[1e6, 0.0], [-1e6, 0.0], [3e6, 0.0]], [1, 0, 1])
    assert linear.fit_svc(df, "x", "y").objective < 1e-6 + 0.5
    assert linear.fit_svc(df.limit(0), "x", "y").weights == (0.0,)
    got = linear.standardised(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted(map(tuple, got)) == [(-1.0, 0.0), (1.0, 0.0)]


# -- boosting -----------------------------------------------------------------------

def plain_boost(x, y, train, p, edges):
    bins = np.array([[0 if v != v else 1 + int((edges[f] < v).sum()) for f, v in enumerate(r)] for r in x])
    n, n1 = int(train.sum()), int(y[train].sum())
    margin = np.full(len(y), np.log(n1 / (n - n1)) if p.prior else 0.0)
    score = lambda g, h: g * g / (h + p.l2 * bo.UNIT)
    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = np.rint((q - y) * bo.UNIT), np.rint(q * (1 - q) * bo.UNIT)
        node, made, depth = np.ones(len(y), int), 2, {1: 0}

        def best(at):
            rows = np.flatnonzero((node == at) & train)
            out = None
            for f in range(x.shape[1]):
                for b in sorted(set(bins[rows, f]) - {0}):
                    for missing_left in (False, True):
                        left = np.where(bins[rows, f] == 0, missing_left, bins[rows, f] <= b)
                        sides = [(g[rows[s]].sum(), h[rows[s]].sum(), s.sum()) for s in (left, ~left)]
                        if any(s[2] < max(1, p.min_rows) or s[1] < p.min_hessian * bo.UNIT for s in sides):
                            continue
                        gain = score(*sides[0][:2]) + score(*sides[1][:2]) - score(g[rows].sum(), h[rows].sum())
                        if gain > 0 and (out is None or (-gain, f, b, missing_left) < out):
                            out = (-gain, f, b, missing_left)
            return out
        open_ = {1: best(1)}
        while True:
            can = {k: c for k, c in open_.items() if c and (p.max_leaves is not None or depth[k] < p.max_depth)}
            if not can or (p.max_leaves is not None and len(set(node[train])) >= p.max_leaves):
                break
            at = min(can, key=lambda k: (can[k][0], k))
            _, f, b, missing_left = open_.pop(at)
            rows = np.flatnonzero(node == at)
            left = np.where(bins[rows, f] == 0, missing_left, bins[rows, f] <= b)
            node[rows] = np.where(left, made, made + 1)
            for k in (made, made + 1):
                depth[k] = depth[at] + 1
                open_[k] = best(k)
            made += 2
        for k in set(node):
            rows = np.flatnonzero((node == k) & train)
            margin[node == k] += p.rate * (-g[rows].sum() / (h[rows].sum() + p.l2 * bo.UNIT))
    return margin


@pytest.mark.parametrize("p", [bo.preset(bo.SECOND_ORDER, rounds=3, max_depth=3), bo.preset(bo.HISTOGRAM, rounds=3, max_depth=3, max_bins=8, min_rows=5),
                               bo.preset(bo.LEAF_WISE, rounds=3, max_leaves=6, min_rows=4, max_bins=12)])
def test_boosting_against_plain(spark, p):
    x, y = data(200, 3, 7)
    x[::5, 1] = np.nan
    x[::11, 0] = np.nan
    train = np.arange(len(y)) % 4 != 0
    df = frame(spark, x, y).withColumn("train", F.col("id") % 4 != 0)
    both = df.withColumn("m", F.lit(0)).unionByName(df.withColumn("m", F.lit(3)).withColumn("train", ~F.col("train")))
    scored, forest = bo.boost(both, p)
    edges = bo.quantile_edges(both.where("train"), "x", p.max_bins, 3)
    got = {(r["m"], r["id"]): r["margin"] for r in scored.collect()}
    assert len(got) == 2 * len(y) and len(forest) == p.rounds and all(len(t[0].cuts) > 1 for t in forest)
    for m, mask in ((0, train), (3, ~train)):
        assert np.allclose([got[m, i] for i in range(len(y))], plain_boost(x, y, mask, p, edges), rtol=0, atol=1e-9)
    if p.max_leaves is None:
        assert all(len(t[m].values) <= 2 ** p.max_depth for t in forest for m in t)


def test_quantile_edges(spark):
    values = [1.0] * 50 + [2.0] * 30 + [float(v) for v in range(3, 103)]
    df = spark.createDataFrame([([v, 7.0 if i else None, float("nan")],) for i, v in enumerate(values)], "x array<double>")
    edges = bo.quantile_edges(df, "x", 4, 3)
    assert [len(e) for e in edges] == [3, 0, 0]
    share = np.bincount(np.searchsorted(edges[0], values, "left")) / len(values)
    assert share.max() < 0.25 + 50 / 180 and len(share) == 4
    assert list(bo.quantile_edges(df, "x", 1000, 3)[0][:3]) == [1.5, 2.5, 3.5]


def test_boosting_edges(spark):
    x, _ = data(30, 3, 1)
    p = bo.preset(bo.SECOND_ORDER, rounds=2)
    df = frame(spark, x, np.ones(30)).select(F.lit(0).alias("m"), "id", F.lit(True).alias("train"), "y", "x")
    assert all(r["margin"] > 0 for r in bo.boost(df, bo.preset(bo.HISTOGRAM, rounds=2))[0].collect())
    assert bo.boost(df.limit(0), p)[0].collect() == []
    assert {r["margin"] for r in bo.boost(df.withColumn("train", F.lit(False)), p)[0].collect()} == {0.0}


# -- boosting in passes over blocks ---------------------------------------------------

def trees_of(forest):
    return [{m: (t.cuts, t.values) for m, t in trees.items()} for trees in forest]


def test_leaves_are_counted_a_level_at_a_time(spark, monkeypatch):
    """A leaf-wise tree is grown in as many passes as it is deep, not one a leaf."""
    x, y = data(3000, 4, 3)
    df = frame(spark, x, y).withColumn("m", F.lit(0)).withColumn("train", F.lit(True))
    p = bo.preset(bo.LEAF_WISE, rounds=2)
    passes, count = [], bo._histograms
    monkeypatch.setattr(bo, "_histograms", lambda *a, **kw: passes.append(1) or count(*a, **kw))
    _, forest = bo.boost(df, p)

    def depth(cuts, node=1):
        return max((1 + max(depth(cuts, c.left), depth(cuts, c.right)) for c in cuts if c.node == node), default=0)
    assert all(len(t[0].values) == 31 and len(t[0].cuts) == 30 for t in forest)
    assert len(passes) < 2 * 20 and max(depth(t[0].cuts) for t in forest) < 20


def test_rows_for_several_models_are_the_rows_of_each(spark, monkeypatch):
    x, y = data(400, 3, 5)
    x[::7, 1] = np.nan
    df = frame(spark, x, y).withColumn("fold", (F.col("id") % 3).cast("int"))
    p = bo.preset(bo.LEAF_WISE, rounds=3, max_leaves=7, min_rows=5, max_bins=20)
    models = F.sequence(F.lit(0), F.lit(2))
    apart = df.select(F.explode(models).alias("m"), "*").withColumn("train", F.col("m") != F.col("fold"))
    want, trees = bo.boost(apart, p)
    want = sorted(map(tuple, want.collect()))
    together = df.select(models.alias("ms"), F.transform(models, lambda m: m != F.col("fold")).alias("trains"), "id", "y", "x").repartition(4).cache()
    assert len(want) == 1200
    for rows, gathered, kept in ((1 << 16, 32 << 20, 20), (37, 0, 1)):   # small blocks, sums added up in a shuffle, every round checkpointed
        monkeypatch.setattr(bo, "MOST_ROWS", rows)
        monkeypatch.setattr(bo, "GATHERED", gathered)
        monkeypatch.setattr(bo, "KEPT_ROUNDS", kept)
        got, forest = bo.boost_together(together, p)
        assert sorted(map(tuple, got.collect())) == want and trees_of(forest) == trees_of(trees)


def test_boosting_keeps_null_ids(spark):
    x, y = data(60, 3, 2)
    df = frame(spark, x, y).select(F.lit(1).alias("m"), F.when(F.col("id") > 9, F.col("id")).alias("id"), (F.col("id") % 2 == 0).alias("train"), "y", "x")
    got = bo.boost(df, bo.preset(bo.HISTOGRAM, rounds=1, min_rows=2))[0].collect()
    assert sorted(r["id"] or 0 for r in got) == [0] * 10 + list(range(10, 60)) and sum(r["id"] is None for r in got) == 10
