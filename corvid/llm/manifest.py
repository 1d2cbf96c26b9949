"""Merkle manifest of a dataset, and proofs by a recursive climb.

Rows are leaves; per group, runs of eight consecutive nodes become their
parent until one is left, the subroot; the subroots, in the order of their
groups, become the root in the same way.  Built levels are stored as node
rows linked to their parents.  A recursive query then climbs from every leaf
to the root: each step appends the siblings of its run and folds the leaf's
(maybe tampered) hash into the run.

A node high up is on the path of very many leaves.  Leaves climb in blocks,
and the stored rows name the block they serve: a high node has a row for each
block under it, so no key of the join holds more than a block.  The siblings
above a block's own top are the same for all its leaves; a climber for the
block appends them once, while each leaf goes on folding its hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import crc_mod, scratch, written
from corvid.operators.ranking import rank_within

#: Children of a node.
RUN = 8
#: Height of a block's own top, and the leaves in it, which climb together.
BASE = 2
BLOCK = RUN ** BASE
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_hash(values: Sequence[Column]) -> Column:
    """sha256 of the values, each ``-`` if NULL, else its UTF-8 byte count, a colon and itself."""
    strings = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings]), 256))


def _ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    n = rows.count()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rank_within(rows, group, order, name, rows_per_bucket=max(1, math.ceil(n / parts)), n_rows=n)


def _levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inner nodes (tree, height, at, n, children, digest) and subroots (tree, digest) over (tree, at, n, digest), n nodes a tree.

    ``children`` are the digests of a run, one after the other.
    """
    spark, folder, height = nodes.sparkSession, scratch(nodes.sparkSession, "levels"), 0
    tops = [nodes.where("n = 1").select("tree", "digest")]
    schema = "tree long, at long, n long, children binary, digest binary"
    path = f"{folder}/height=0"
    nodes.limit(0).selectExpr("tree", "at", "n", "digest AS children", "digest").write.parquet(path)
    while not (more := nodes.where("n > 1")).isEmpty():
        height += 1
        path = f"{folder}/height={height}"
        run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: F.hex(x["digest"])), "")
        (more.groupBy("tree", F.expr(f"at div {RUN}").alias("parent")).agg(F.expr(f"(max(n) + {RUN - 1}) div {RUN}").alias("n"), F.lower(run).alias("run"))
         .select("tree", F.col("parent").alias("at"), "n", F.unhex("run").alias("children"), F.unhex(F.sha2("run", 256)).alias("digest")).write.parquet(path))
        nodes = spark.read.schema(schema).parquet(path)
        tops.append(nodes.where("n = 1").select("tree", "digest"))
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionAll(t)
    return spark.read.schema(f"{schema}, height int").parquet(folder), subroots


def _served(inner: DataFrame, trees: DataFrame, upper: DataFrame, groups: int) -> DataFrame:
    """Parent-linked rows (tree, block, height, base, at, parent, place, children) of the nodes that lead from a block to the root.

    The nodes above a tree's subroot follow its own ones, with their heights
    counted on from the tree's (``top``).  ``base`` is the height of the
    block's own top.  ``parent`` is NULL at the root.
    """
    size = f"cast(pow({RUN}, {{}}) AS bigint)"
    base = F.least(F.lit(BASE), F.col("top")).alias("base")
    own = inner.join(trees, "tree").select(
        "tree", "height", base, "at", "children",
        F.when(F.col("n") > 1, F.expr(f"at div {RUN}")).when(F.lit(groups > 1), F.expr(f"tree div {RUN}")).alias("parent"),
        F.when(F.col("n") > 1, F.col("at") % RUN).otherwise(F.col("tree") % RUN).alias("place"),
        F.expr(f"at * {size.format('height')} div {BLOCK}").alias("first"),
        F.expr(f"(least((at + 1) * {size.format('height')}, leaves) - 1) div {BLOCK}").alias("last"))
    over = (trees.withColumn("up", F.explode(F.sequence(F.lit(1), F.lit(max(1, _height(groups))))))
            .withColumn("u", F.expr(f"tree div {size.format('up')}"))
            .join(upper.select(F.col("height").alias("up"), F.col("at").alias("u"), "n", "children"), ["up", "u"])
            .select("tree", (F.col("top") + F.col("up")).alias("height"), base, F.col("u").alias("at"), "children",
                    F.when(F.col("n") > 1, F.expr(f"u div {RUN}")).alias("parent"), (F.col("u") % RUN).alias("place"),
                    F.lit(0).cast("long").alias("first"), F.expr(f"(leaves - 1) div {BLOCK}").alias("last")))
    # In two steps, so that neither the list of a root's blocks nor its rows are one task's.
    wide = 4096
    parts = own.unionByName(over).withColumn("start", F.explode(F.sequence("first", "last", F.lit(wide).cast("long")))).repartition("tree", "start", "height")
    return parts.withColumn("block", F.explode(F.sequence("start", F.least("last", F.col("start") + wide - 1)))).select(
        "tree", "block", F.col("height").cast("int").alias("height"), "base", "at", "parent", F.col("place").cast("int").alias("place"), "children")


def _height(n: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // RUN), height + 1
    return height


# ``at`` is NULL in the climber of a block, which appends the siblings above the block's top.
_CLIMB = """
WITH RECURSIVE climb(tree, block, at, height, node, place, hash, siblings) MAX RECURSION LEVEL 100 AS (
  SELECT tree, block, at, height, parent, place, hash, X'' FROM {start}
  UNION ALL
  SELECT c.tree, c.block, c.at, n.height, n.parent, n.place,
         unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.place), c.hash, substring(n.children, 32 * c.place + 33)))), 256)),
         CASE WHEN (n.height > n.base) = (c.at IS NULL)
              THEN concat(substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33)) ELSE X'' END
  FROM climb c JOIN {nodes} n ON n.tree = c.tree AND n.block = c.block AND n.height = c.height + 1 AND n.at = c.node
  WHERE c.node IS NOT NULL)
SELECT * FROM climb LIMIT ALL"""


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group_col: str = "lang", id_col: str = "doc_id",
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """Merkle tree over all rows, and what each leaf's proof says about a tampered copy.

    Returns one row per input row: the id, leaf, subroot (of its group), root,
    proof_sha256 (sha256 of the siblings from the leaf's run up to the
    root's, left to right), folded_root (from the tampered leaf and the
    original siblings) and verified (folded_root is the root).  Digests are
    lowercase hex.  ``tampered`` maps columns to what a tampered copy holds
    there; by default the text of the ids whose crc32 3 divides, with A-Z in
    lower case.

    Leaves of a group go by id (NULL first), then by their hash, so repeated
    rows are leaves of their own; a NULL group is a group and comes first.
    NULL columns stay NULL when tampered with; a NULL id counts as the empty
    text where ids are drawn.  Empty and very long texts are hashed whole; an
    empty table has no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    if tampered is None:
        tampered = {"text": F.when(crc_mod(docs[id_col], 3) == 0, F.translate(docs["text"], _AZ, _AZ.lower())).otherwise(docs["text"])}
    values = [docs[c] for c in columns]
    changed = [tampered.get(c, docs[c]) for c in columns]
    leaves = written(docs.select(docs[group_col].alias("g"), docs[id_col].alias("id"), leaf_hash(values).alias("digest"), leaf_hash(changed).alias("hash")))
    if leaves.isEmpty():
        none = leaves.select(F.col("id").alias(id_col), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
        return none.where("false")
    sizes = written(_ranked(leaves.groupBy("g").agg(F.count("*").alias("leaves")), [], ["g"], "tree"))
    groups = sizes.count()
    placed = _ranked(leaves, ["g"], ["id", "digest"], "at")
    placed = written(placed.join(sizes, placed["g"].eqNullSafe(sizes["g"])).select("tree", "at", F.col("leaves").alias("n"), "id", "digest", "hash"))
    inner, subroots = _levels(placed.select("tree", "at", "n", "digest"))
    upper, roots = _levels(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(groups).cast("long").alias("n"), "digest"))
    root = F.lower(F.hex(F.lit(bytes(roots.first()["digest"]))))
    tops = inner.groupBy("tree").agg(F.max("height").alias("top"))
    trees = written(sizes.join(tops, "tree", "left").select("tree", "leaves", F.coalesce("top", F.lit(0)).alias("top")))
    nodes = written(_served(inner, trees, upper, groups))
    block = F.expr(f"at div {BLOCK}").alias("block")
    alone = F.col("n") == 1
    leaf = placed.select(
        "tree", block, "at", F.lit(0).alias("height"), F.when(~alone, F.expr(f"at div {RUN}")).when(F.lit(groups > 1), F.expr(f"tree div {RUN}")).alias("parent"),
        F.when(alone, F.col("tree") % RUN).otherwise(F.col("at") % RUN).cast("int").alias("place"), "hash", alone.alias("alone"))
    none = lambda kind: F.lit(None).cast(kind)
    climbers = nodes.where("height = base").select("tree", "block", none("long").alias("at"), "height", "parent", "place", none("binary").alias("hash")).unionAll(
        leaf.where("alone").select("tree", "block", none("long"), "height", "parent", "place", none("binary")))
    climbed = spark.sql(_CLIMB, start=leaf.drop("alone").unionAll(climbers), nodes=nodes)
    # The rows that say something: siblings, a leaf's end, and what it is.  The recursion is read once, and one exchange
    # brings a block's leaves and its climber together.
    said = climbed.where("length(siblings) > 0 OR (at IS NOT NULL AND node IS NULL)").select(
        "tree", "block", "at", "height", F.when(F.col("node").isNull(), F.col("hash")).alias("folded"), "siblings", none(placed.schema["id"].dataType).alias("id"), none("binary").alias("digest"))
    rows = said.unionAll(placed.select("tree", block, "at", F.lit(-1), none("binary"), none("binary"), "id", "digest")).repartition("tree", "block")
    siblings = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("height", F.coalesce("siblings", F.lit(b"")).alias("s")))), lambda x: F.hex(x["s"])), "")
    each = rows.groupBy("tree", "block", "at").agg(siblings.alias("siblings"), F.max("folded").alias("folded"), F.max("id").alias("id"), F.max("digest").alias("digest"))
    shared = F.max(F.when(F.col("at").isNull(), F.col("siblings"))).over(Window.partitionBy("tree", "block"))
    proofs = each.withColumn("high", F.coalesce(shared, F.lit(""))).where("at IS NOT NULL")
    text = lambda c: F.lower(F.hex(c))
    return (proofs.join(written(subroots.withColumnRenamed("digest", "subroot")), "tree")
            .select(F.col("id").alias(id_col), text("digest").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
                    F.sha2(F.lower(F.concat("siblings", "high")), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified")))
