import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvid.llm.periods import find_runs, lyndon_array, periodic_runs
from corvid.llm.q_structure import op12_periodic_runs


def longest_lyndon(x, i):
    best = 1
    for j in range(i + 1, len(x) + 1):
        w = x[i:j]
        if all(w < w[k:] for k in range(1, len(w))):
            best = j - i
    return best


def plain_runs(x, least=24, times=3):
    found = set()
    for p in range(1, len(x) // times + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(least, times * p) and not any(all(x[k] == x[k + d] for k in range(i, i + n - d)) for d in range(1, p)):
                found.add((i, n, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, loop):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if loop and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n_, p in found for i in range(s + p, s + n_)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n_},{p}\n" for s, n_, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@given(st.lists(st.integers(0, 2), max_size=14))
def test_lyndon_array(x):
    assert lyndon_array(x) == [longest_lyndon(x, i) for i in range(len(x))]
    y = [-v for v in x]
    assert lyndon_array(y) == [longest_lyndon(y, i) for i in range(len(x))]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=6), st.sampled_from([(6, 3), (24, 3), (12, 4)]))
def test_find_runs(parts, limits):
    x = [v for unit, times in parts for v in unit * times]
    assert find_runs([x, [], x[::-1]], *limits) == [plain_runs(x, *limits), [], plain_runs(x[::-1], *limits)]


def test_thue_morse_and_fibonacci():
    t = [bin(i).count("1") % 2 for i in range(5000)]
    assert find_runs([t], 6, 3) == [[]]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert find_runs([b], 6, 3) == [plain_runs(b, 6, 3)] and find_runs([b], 6, 3)[0]


def test_query_against_plain(spark):
    d = "/root/testdata/sf0.001"
    want = sorted(plain_row(r["doc_id"], r["text"], True) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = op12_periodic_runs(spark, d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark):
    rng = random.Random(5)
    block = " ".join(f"w{rng.randrange(9)}" for _ in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 30), (4, "a b " * 30), (4, "a b " * 30), (5, "x " * 24 + "y " * 24 + "x " * 23),
            (6, (block + " ") * 5 + block[:50]), (7, ("ä " * 11 + "ö\u00a0b\x0bc\x0c") * 9), (8, "a " * 50_000), (9, " ".join(str(k) for k in range(60_000))),
            (10, "a b c d e f g h " * 3), (11, "a b c d e f g h " * 2 + "a b c d e f g"), (12, "".join(f"{block} {k} " for k in range(4)))]
    df = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, n_runs string, row int")
    got = sorted(map(tuple, periodic_runs(df.repartition(3)).collect()), key=str)
    slow = {8: (8, 1, 0, 50_000, 1, 50_000_000)}
    want = sorted((plain_row(i, t, False) for i, t in rows if i not in (8, 9)), key=str)
    assert [r for r in got if r[0] not in (8, 9)] == want
    by_id = {r[0]: r for r in got}
    assert by_id[8][:6] == slow[8] and by_id[9][1] == 0 and by_id[10][1] == 1 and by_id[11][1] == 0
    assert sorted(map(tuple, periodic_runs(df, loop=True).where("doc_id < 8 OR doc_id IS NULL").collect()), key=str) == sorted(
        (plain_row(i, t, True) for i, t in rows if i is None or i < 8), key=str)
    assert periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(df, min_periods=2)
