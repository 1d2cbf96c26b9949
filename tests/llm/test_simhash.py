import random
import re

import numpy as np
import xxhash

from corvid.llm import simhash
from corvid.llm.components import components
from corvid.llm.q_dedup import op5_simhash_near_dedup


def brute_fp(text, shingle=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows, distance=2):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, f"{fps[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op5_simhash_near_dedup(spark, d).collect()), key=str) == brute_groups(rows)


def test_odd_rows(spark):
    rows = [(None, None), (3, ""), (2, " \n"), (2, " \n"), (7, "A b"), (8, "a B"), (9, "a b c d"), (None, "long " * 30000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, node int")
    assert sorted(map(tuple, simhash.simhash_groups(df).collect()), key=str) == brute_groups(rows)
    assert simhash.simhash_groups(df.limit(0)).collect() == []


def test_no_link_is_lost(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(8)} | {1 << k for k in range(64)} | {0})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2)
    got = {r["node"]: r["label"] for r in components(links).collect()}
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 2:
                a1, b1 = sorted((find(signed[i]), find(signed[j])))
                parent[b1] = a1
    assert {s: got.get(s, s) for s in signed} == {s: find(s) for s in signed}


def test_chain_and_star_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(-5, -9), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(60)} | {-5: -9, -9: -9}


def test_links_in_large_cells_at_every_distance():
    rng = random.Random(5)
    fps = sorted({rng.getrandbits(7) | rng.getrandbits(6) << 20 for _ in range(400)} | {0b0110, 0b0111, 0b1010, 0b1110})
    for distance in range(5):
        a, b = simhash.links_in_cells(np.zeros(len(fps), np.uint64), np.array(fps, np.uint64), distance)
        links = list(zip(a.tolist(), b.tolist()))
        assert all((x ^ y).bit_count() <= distance for x, y in links)

        def parts(pairs):
            parent = {f: f for f in fps}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x
            for x, y in pairs:
                lo, hi = sorted((find(x), find(y)))
                parent[hi] = lo
            return {f: find(f) for f in fps}
        assert parts(links) == parts((x, y) for k, x in enumerate(fps) for y in fps[:k] if (x ^ y).bit_count() <= distance), distance
