"""Benchmark decontamination by SimHash of item-sized windows.

A document can only repeat an item if it holds one of the item's rarest
shingles (as many as may differ, and one more), so documents and items meet
there.  In such a pair, a window as long as the item is looked at if it holds
as many of the item's shingles as the similarity needs.  These windows get a
SimHash fingerprint.  Item fingerprints are indexed by blocks of bits: two
fingerprints within ``radius`` differ in at most radius // blocks bits of some
block, so an item listed under every such value of every block is found from
each window within the radius.  Found pairs are compared bit by bit and then,
once each, by their weighted shingles.  DataFrame functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import numbered, numbered_once, written

#: Words of a shingle, least weighted similarity, radius in bits and number of bit blocks.
SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 10


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingled(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``n`` (words) and ``grams`` (shingle hashes) to rows with a ``text``, which is dropped.

    Words are runs of letters and digits, lower-cased; a shingle is hashed
    from the hashes of its words.  Fewer words than a shingle: no grams.
    """
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))
    grams = lambda w: F.when(F.size(w) >= shingle, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - shingle + 1, F.lit(1))),
        lambda k: F.xxhash64(*[F.element_at(w, k + j) for j in range(shingle)]))).otherwise(F.array().cast("array<bigint>"))
    both = let(words, lambda w: F.struct(F.size(w).alias("n"), grams(w).alias("grams")))
    kept = [c for c in rows.columns if c != "text"]
    return rows.select(*kept, both.alias("both")).select(*kept, "both.n", "both.grams")


def fingerprint(grams: Column) -> Column:
    """Majority bits of an array of hashes, repeats included."""
    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(grams, F.lit(0), lambda c, h: c + F.getbit(h, b).cast("int"))
        return acc.bitwiseOR(F.when(2 * ones > F.size(grams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def blocks_of(fp: Column, blocks: int = BLOCKS) -> list[tuple[Column, int]]:
    """(value, bits) of the blocks of a fingerprint."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)), b - a) for a, b in zip(edges, edges[1:])]


def index_keys(fp: Column, radius: int, blocks: int = BLOCKS) -> Column:
    """All (block, value) keys under which a fingerprint is listed."""
    def listed(k: int, value: Column, bits: int) -> Column:
        flips = [sum(1 << j for j in js) for r in range(min(bits, radius // blocks) + 1) for js in combinations(range(bits), r)]
        return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]),
                           lambda x: F.struct(F.lit(k).alias("block"), value.bitwiseXOR(x).alias("value")))
    return F.concat(*[listed(k, v, bits) for k, (v, bits) in enumerate(blocks_of(fp, blocks))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over the sum of the larger counts of two arrays' values."""
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def rare_shingles(items: DataFrame, similarity: float) -> DataFrame:
    """(h, item_row): of each item's shingles, those held by the fewest items, one more than may be missing at ``similarity``."""
    each = items.select("item_row", F.size("item_grams").alias("m"), F.explode("item_grams").alias("h"))
    held = each.select("item_row", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    # Repeats count: a shingle that an item holds twice may be missing twice.
    order = Window.partitionBy("item_row").orderBy("items", "h")
    spare = F.col("m") - F.ceil(F.col("m") * similarity - 1e-9) + 1
    return (each.join(held, "h").withColumn("place", F.row_number().over(order)).where(F.col("place") <= spare)
            .select("h", "item_row").distinct())


def window_starts(grams: Column, item_grams: Column, n: Column, size: Column, similarity: float, shingle: int = SHINGLE) -> Column:
    """Starts of the item-sized windows of a document that hold enough of the item's shingles for ``similarity``."""
    m = size - shingle + 1
    need = F.greatest(F.ceil((F.least(F.size(grams), m) + m) * similarity / (1 + similarity) - 1e-9).cast("int"), F.lit(1))
    hits = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda k: F.array_contains(item_grams, F.get(grams, k)))
    last = F.greatest(n - size, F.lit(0))

    def ranges(h: Column) -> Column:
        # A window holds enough hits if it spans some run of just so many.
        def between(i: Column) -> Column:
            low, high = F.greatest(F.get(h, i + need - 1) - m + 1, F.lit(0)), F.least(F.get(h, i), last)
            return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(h) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - need, F.lit(0))), between)))
    return F.array_distinct(let(hits, ranges))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", row_col: str | None = None,
                 radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of documents and benchmark items that a window of the document repeats.

    Returns (row_col,) the document's id, the item's id, start_word of the best
    window, its n_words, and its weighted similarity (of ``similarity`` or
    more), one row per input row and item row.  Windows are as long as the
    item and start at every word; a document shorter than the item is one
    window.  Only windows that hold enough of an item's shingles are
    fingerprinted: others are below the similarity.  NULL, empty and short texts
    (under five words) have no shingles and match nothing, on either side;
    NULL and repeated ids, repeated documents and items are matched row by row;
    other columns are dropped.
    """
    texts = numbered_once(docs, id_col, text_col, row_col)
    items = written(shingled(numbered(benchmark, item_col, item_text_col)).where(F.size("grams") > 0)
                    .select(F.col("row").alias("item_row"), F.col("id").alias("item"), F.col("n").alias("size"), F.col("grams").alias("item_grams"),
                            fingerprint(F.col("grams")).alias("item_fp")))
    listed = written(rare_shingles(items, similarity))
    pairs = written(shingled(texts).select("row", F.explode("grams").alias("h")).join(listed, "h").select("row", "item_row").distinct())
    held = shingled(texts.join(pairs.select("row").distinct(), "row", "left_semi"))
    windows = (held.join(pairs, "row").join(items.select("item_row", "item", "size", "item_grams", "item_fp"), "item_row")
               .withColumn("start", F.explode(window_starts(F.col("grams"), F.col("item_grams"), F.col("n"), F.col("size"), similarity)))
               .withColumn("grams", F.slice("grams", F.col("start") + 1, F.col("size") - SHINGLE + 1))
               .withColumn("fp", fingerprint(F.col("grams"))))
    keys = F.array(*[F.struct(F.lit(k).alias("block"), v.alias("value")) for k, (v, _) in enumerate(blocks_of(F.col("fp")))])
    index = items.select("item_row", F.explode(index_keys(F.col("item_fp"), radius)).alias("key"))
    # A pair that several blocks find is one pair.
    found = (windows.select("row", "item_row", "start", F.explode(keys).alias("key")).join(index, ["item_row", "key"])
             .select("row", "item_row", "start").distinct())
    near = (windows.join(found, ["row", "item_row", "start"], "left_semi")
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .withColumnRenamed("size", "n_words")
            .withColumn("similarity", weighted_similarity(F.col("grams"), F.col("item_grams")))
            .where(F.col("similarity") >= similarity))
    best = near.groupBy("row", "item_row").agg(
        F.first("id").alias("id"), F.first("item").alias("item"), F.first("n_words").alias("n_words"),
        F.max("similarity").alias("similarity"), F.min(F.struct(-F.col("similarity"), F.col("start"))).alias("first"))
    keep = [F.col("row").alias(row_col)] if row_col else []
    return best.select(*keep, F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("first.start").alias("start_word"),
                       "n_words", "similarity")
