"""Decision tree with exact thresholds (ML6).

A level is grown for all its nodes at once: class counts per (node, feature,
value), their prefix sums in value order (range partitioned, see
:func:`corvid.operators.ranking.running_sums`), the impurity of a cut after
each value, and the best cut per node by one aggregate.  No value is binned
and no row leaves the executors; a tree has at most ``2 ** max_depth`` leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators.ranking import ROWS_PER_BUCKET, running_sums


@dataclass(frozen=True)
class Tree:
    """``splits``: (node, feature, threshold) per level; ``leaves``: (node, n, n1, prediction).  Node 1 is the root,
    node ``2 n`` holds the rows of node ``n`` with ``x[feature] <= threshold`` (or NULL), ``2 n + 1`` the others."""
    splits: tuple[DataFrame, ...]
    leaves: DataFrame


def _descend(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Rows (.., _x, node) one level further down; rows of a node without a split stay."""
    right = F.coalesce(F.get("_x", F.col("feature")) > F.col("threshold"), F.lit(False)).cast("long")
    node = F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + right)
    return rows.join(split, "node", "left").select(*[c for c in rows.columns if c != "node"], node.alias("node"))


def best_splits(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(node, feature, threshold) of the nodes of (_x, y, node) that can be cut.

    A node is cut if it holds both classes and some feature has two values.
    The cut has the smallest ``l0 l1 / l + r0 r1 / r`` (half the Gini
    impurity, by rows), then the first feature, then the lowest threshold,
    which lies halfway between two values (on the lower one if no double does).
    """
    cells = (rows.select("node", "y", F.posexplode("_x").alias("feature", "value")).where("value IS NOT NULL")
             .groupBy("node", "feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")))
    sizes = cells.groupBy("node", "feature").agg(F.sum("n").alias("all"), F.sum("n1").alias("all1"))
    cut = running_sums(cells, ["node", "feature"], "value", ["n", "n1"], rows_per_bucket).where("value_next IS NOT NULL")
    cut = cut.join(sizes, ["node", "feature"]).where("all1 > 0 AND all1 < all")
    half = lambda n, n1: (F.col(n1).cast("double") * (F.col(n) - F.col(n1)).cast("double")) / F.col(n).cast("double")
    cut = cut.withColumns({"r": F.col("all") - F.col("n_upto"), "r1": F.col("all1") - F.col("n1_upto")})
    middle = F.col("value") / 2 + F.col("value_next") / 2
    threshold = F.when(middle < F.col("value_next"), middle).otherwise(F.col("value"))
    best = F.min(F.struct((half("n_upto", "n1_upto") + half("r", "r1")).alias("impurity"), "feature", threshold.alias("threshold")))
    return cut.groupBy("node").agg(best.alias("b")).select("node", "b.feature", "b.threshold")


def fit_tree(rows: DataFrame, features: str, label: str, max_depth: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> Tree:
    """A tree of at most ``max_depth`` levels of cuts for labels 0 and 1 over an array column.

    NULL values lie on the left of every cut and are left out of its choice;
    an empty table gives a tree without leaves.
    """
    state = rows.select(F.col(features).cast("array<double>").alias("_x"), F.col(label).cast("long").alias("y"),
                        F.lit(1).cast("long").alias("node")).checkpoint()
    splits = []
    for _ in range(max_depth):
        split = best_splits(state, rows_per_bucket).checkpoint()
        if split.isEmpty():
            break
        splits.append(split)
        state = _descend(state, split).checkpoint()
    leaves = (state.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
              .withColumn("prediction", (2 * F.col("n1") > F.col("n")).cast("double")))
    return Tree(tuple(splits), leaves.checkpoint())


def tree_leaves(rows: DataFrame, features: str, tree: Tree) -> DataFrame:
    """``rows`` with the leaf (node) each one falls into and its prediction; the larger class, 0 in a tie."""
    state = rows.withColumns({"_x": F.col(features).cast("array<double>"), "node": F.lit(1).cast("long")})
    for split in tree.splits:
        state = _descend(state, split)
    return state.drop("_x").join(tree.leaves.select("node", "prediction"), "node", "left")
