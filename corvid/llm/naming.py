"""Exact deduplication by deterministic block naming.

Normalised texts are cut into fixed-size blocks; distinct blocks are sorted
and numbered; adjacent names are paired, distinct pairs sorted and numbered,
and so on until each document has one name.  Two documents of as many levels
have one name exactly if their texts are equal: names stand for contents, not
for hashes.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import numbered, remove, scratch, written

#: Bytes of a block.
BLOCK = 4096
#: ASCII white space, as the regular expression that is deleted.
BLANK = r"[\x20\x09-\x0D]+"


def _keys(column: Column, seed: int) -> tuple[Column, Column]:
    """Two 64-bit hashes of a block, to carry instead of its content."""
    return F.xxhash64(F.lit(2 * seed), column), F.xxhash64(F.lit(2 * seed + 1), column)


def name_blocks(blocks: DataFrame, seed: int = 0) -> tuple[DataFrame, int]:
    """(k1, k2, name) of the distinct contents of column ``block``, and the hash seed.

    Distinct contents are sorted within their partition and numbered.  Names
    are joined back by two hashes, which spares a second shuffle of contents;
    the hashes are checked to be injective on these contents, and taken with
    another seed if they are not, so no two contents share a name.
    """
    while True:
        k1, k2 = _keys(F.col("block"), seed)
        names = (blocks.groupBy("block").agg(F.lit(1).alias("one")).sortWithinPartitions("block")
                 .select(k1.alias("k1"), k2.alias("k2"), F.monotonically_increasing_id().alias("name")).checkpoint())
        if names.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            return names, seed
        seed += 1


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, levels, name) of (row, body), body being binary: equal (levels, name) means equal bodies.

    Each level halves the number of names per document, and only documents
    with more than one name go on.
    """
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("body") - 1, F.lit(0)) / block).cast("int")),
                      lambda k: F.substring(F.col("body"), k * block + 1, F.lit(block)))
    blocks = texts.select("row", cut.alias("blocks"))
    names, seed = name_blocks(blocks.select(F.explode("blocks").alias("block")))
    k1, k2 = _keys(F.col("col"), seed)
    held = (blocks.select("row", F.size("blocks").alias("n"), F.posexplode("blocks"))
            .select("row", "n", F.col("pos").alias("at"), k1.alias("k1"), k2.alias("k2"))
            .join(names, ["k1", "k2"]).select("row", "n", "at", "name").checkpoint())
    level, done = 0, []
    while True:
        done.append(held.where("n = 1").select("row", F.lit(level).alias("levels"), "name"))
        more = held.where("n > 1")
        if more.isEmpty():
            break
        # An odd last name is paired with -1, which is no name.
        even = F.col("at") % 2 == 0
        pairs = (more.groupBy("row", (F.col("n") + 1).cast("int").alias("n1"), F.floor(F.col("at") / 2).cast("int").alias("half"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"))
                 .select("row", F.floor(F.col("n1") / 2).cast("int").alias("n"), F.col("half").alias("at"), "left", "right").checkpoint())
        numbers = (pairs.groupBy("left", "right").agg(F.lit(1).alias("one")).sortWithinPartitions("left", "right")
                   .select("left", "right", F.monotonically_increasing_id().alias("name")).checkpoint())
        held = pairs.join(numbers, ["left", "right"]).select("row", "n", "at", "name").checkpoint()
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                 block: int = BLOCK) -> DataFrame:
    """Groups of documents whose texts are equal after deleting ASCII white space.

    Returns one row per input row: (row_col,) the id, keep_id (the id of the
    row that stays), group_size, kept and text_sha256 (normalised text, UTF-8,
    lowercase hex).  The row with the most code points in its original text
    stays, then the smallest id (NULL last), then the first row.  NULL text is
    empty; empty and blank texts form one group; repeated rows are one group
    of which exactly one row is kept; other columns are dropped.

    A group of copies is aggregated before every shuffle of its contents or
    counts; the joins back carry names and rows only and are left to skew
    splitting.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "normalised")
    plain = F.regexp_replace("text", BLANK, "")
    try:
        # White space is deleted once; what follows reads the normalised texts.
        rows = written(numbered(docs, id_col, text_col, row_col).select(
            "row", "id", F.length("text").alias("size"), F.sha2(plain, 256).alias("text_sha256"), plain.cast("binary").alias("body")), path)
        names = identities(rows.select("row", "body"), block)
        all_ = rows.drop("body").join(names, "row").checkpoint()
    finally:
        remove(spark, path)
    group = ["levels", "name"]
    # The row that stays, combined before the shuffle.  Its table is written, so that a large group's join back can be split.
    best = F.min(F.struct(-F.col("size"), F.col("id").isNull().alias("unnamed"), "id", "row"))
    of = (all_.groupBy(*group).agg(F.count("*").alias("group_size"), best.alias("best"))
          .select(*group, "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("first")).checkpoint())
    keep = [F.col("row").alias(row_col)] if row_col else []
    return all_.join(of, group).select(*keep, F.col("id").alias(id_col), "keep_id", "group_size",
                                       (F.col("row") == F.col("first")).alias("kept"), "text_sha256")
