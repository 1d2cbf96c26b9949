import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corvid.llm import decontaminate as d
from corvid.llm.q_filters import op8_benchmark_decontamination

D = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w):
    return [tuple(w[k:k + 5]) for k in range(len(w) - 4)]


def brute(docs, items, similarity=0.8):
    """Best weighted similarity over all item-sized windows, without fingerprints."""
    out = {}
    items = [(i, len(words(t)), Counter(grams(words(t)))) for i, t in items]
    known = {g for _, _, c in items for g in c}
    for i, t in docs:
        w = words(t)
        gs = grams(w)
        at = [k for k, g in enumerate(gs) if g in known]
        for item, n, c in items:
            starts = {s for k in at if gs[k] in c for s in range(max(0, k - n + 5), min(k, max(0, len(w) - n)) + 1)}
            for s in starts:
                x = Counter(gs[s:s + n - 4])
                both = sum((x & c).values())
                sim = both / (sum(x.values()) + sum(c.values()) - both)
                if sim >= similarity:
                    out[i, item] = max(out.get((i, item), 0), round(sim, 9))
    return out


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in op8_benchmark_decontamination(spark, D).collect()}
    assert want and got == want


def test_edited_passages_and_odd_rows(spark):
    rng = random.Random(3)
    voc = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(20, 60)))) for k in range(8)] + [(50, None), (51, ""), (52, "one two three"), (None, " ".join(text(30)))]
    docs = [(None, None), (1, ""), (2, "w1 w2"), (2, "w1 w2")]
    for k in range(8):
        w = items[k][1].split()
        docs += [(10 + k, " ".join(text(40) + w + text(30))), (10 + k, " ".join(w).upper()), (30 + k, "; ".join(text(7) + w[:-2] + text(9)))]
        edited = list(w)
        edited[len(w) // 2] = "changed"
        docs += [(60 + k, " ".join(edited + text(20))), (80 + k, " ".join(w[: len(w) // 2] + text(50)))]
    docs.append((99, " ".join(items[-1][1].split() + text(30_000))))
    dd = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, size string")
    bb = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = d.contaminated(dd, bb).collect()
    got = {}
    for r in rows:
        k = (r["doc_id"], r["item_id"])
        got[k] = max(got.get(k, 0), round(r["similarity"], 9))
    want = brute(docs, items)
    assert got == want and (99, None) in got
    assert sum(r["doc_id"] == 13 for r in rows) == 2
    assert d.contaminated(dd.limit(0), bb).collect() == [] and d.contaminated(dd, bb.limit(0)).collect() == []


def test_index_finds_everything_within_the_radius(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << j for j in rng.sample(range(64), rng.randint(0, d.RADIUS)))
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    probe = F.array(*[F.struct(F.lit(k).alias("block"), v.alias("value")) for k, (v, _) in enumerate(d.blocks_of(F.col("a")))])
    assert df.where(F.arrays_overlap(probe, d.index_keys(F.col("b"), d.RADIUS))).count() == len(pairs)


def test_items_that_share_a_passage_meet_few_documents(spark):
    """10,000 items of one size that begin alike: documents with that beginning are paired by rarer shingles only."""
    head = "all items of this set begin in just this way"
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.lit(head), *[F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(14)]).alias("text"))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("before it"), F.lit(head), F.concat(F.lit("own"), F.col("id")), F.lit("and more words")).alias("text"))
    docs = docs.unionAll(items.where("item_id % 2500 = 7").select(F.col("item_id") + 1000, F.concat_ws(" ", F.lit("x y"), "text", F.lit("z"))))
    texts = d.shingled(items.select(F.col("item_id").alias("item_row"), "text")).select("item_row", F.col("grams").alias("item_grams"))
    listed = d.rare_shingles(texts, 0.8).checkpoint()
    assert listed.groupBy("item_row").count().agg(F.max("count")).first()[0] <= 5 and listed.count() <= 50_000
    pairs = d.shingled(docs.select("doc_id", "text")).select("doc_id", F.explode("grams").alias("h")).join(listed, "h").select("doc_id", "item_row").distinct()
    assert pairs.count() == 4
    assert sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()) == [(k + 1000, k) for k in (7, 2507, 5007, 7507)]


def test_window_starts_against_plain_counting(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        n, size = rng.randint(5, 40), rng.randint(5, 25)
        rows.append(([rng.randint(0, 6) for _ in range(n - 4)], [rng.randint(0, 5) for _ in range(size - 4)], n, size))
    df = spark.createDataFrame(rows, "g array<long>, i array<long>, n int, size int")
    got = df.select("*", d.window_starts(F.col("g"), F.col("i"), F.col("n"), F.col("size"), 0.8).alias("starts")).collect()
    for r in got:
        m, held = r["size"] - 4, Counter(r["i"])
        for s in range(max(0, r["n"] - r["size"]) + 1):
            window = Counter(r["g"][s:s + m])
            both = sum((window & held).values())
            if both / (sum(window.values()) + m - both) >= 0.8:
                assert s in (r["starts"] or [])
        assert all(0 <= s <= max(0, r["n"] - r["size"]) for s in r["starts"] or [])
