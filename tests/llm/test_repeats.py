import hashlib
import random
import re
from collections import Counter

import pytest

from corvid.llm import blocks, common, suffixes
from corvid.llm.q_dedup import op4_substring_dedup, op9_suffix_array_dedup


def brute_windows(rows, width=35):
    docs = [(i, [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w]) for i, t in rows]
    seen = Counter(tuple(w[k:k + width]) for _, w in docs for k in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_strings(rows, width=50):
    docs = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for o, _, b in docs:
        for k in range(len(b) - width + 1):
            s = b[k:k + width]
            first[s] = min(first.get(s, o), o)
    out = []
    for o, i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k:k + width]] < o:
                gone[k:k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def windows(df, **k):
    return sorted((tuple(r)[:4] for r in blocks.repeated_windows(df, **k).collect()), key=str)


def strings(df, **k):
    return sorted((tuple(r)[:5] for r in suffixes.repeated_strings(df, **k).collect()), key=str)


@pytest.fixture(params=[False, True], ids=["one chunk", "many chunks"])
def small(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(common, "CHUNK_BYTES", 700)
        monkeypatch.setattr(common, "BUCKET_KEYS", 300)
        monkeypatch.setattr(suffixes, "SLICE", 333)


def test_queries_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:4] for r in op4_substring_dedup(spark, d).collect()), key=str) == brute_windows(rows)
    assert sorted((tuple(r)[:5] for r in op9_suffix_array_dedup(spark, d).collect()), key=str) == brute_strings(rows)


def odd_rows():
    rng = random.Random(7)
    words = [f"w{k}é" if k % 9 == 0 else f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    part, other = text(60), text(36)
    rows = [(5, f"{text(30)} {part}\n{text(20)}"), (3, f"{text(11)}\t{part} {text(9)}"), (3, f"{part}"), (None, part), (None, text(40) + " " + part[5:200]),
            (9, "a " * 200), (8, "a " * 180 + "b"), (2, "x" * 400), (1, "x" * 120 + "y"), (7, None), (6, ""), (6, " \n \x0b"), (10, other), (11, other), (12, other[:-1]),
            (13, f"{other} {part} {other}"), (14, text(34)), (15, "é" * 60), (16, "zé" + "é" * 60), (17, text(300) + " " + text(50) * 2)]
    return rows + [(100 + k, f"{text(5)} {part[k * 3:k * 3 + 150]} {text(4)}") for k in range(12)]


def test_odd_rows(spark, small):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, row int, kept string").repartition(3)
    assert windows(df) == brute_windows(rows)
    assert strings(df) == brute_strings(rows)
    assert windows(df.limit(0)) == [] and strings(df.limit(0)) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_small_alphabet(spark, small, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 30), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 200)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert windows(df, width=7) == brute_windows(rows, 7)
    assert strings(df, width=12, gram=5) == brute_strings(rows, 12)


def test_kept_text(spark):
    rows = [(1, "p " * 3 + " ".join(map(str, range(40)))), (2, " ".join(map(str, range(40))) + " q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], r["spans"]) for r in blocks.repeated_windows(df, with_text=True).collect()}
    assert got == {1: ("p p p", "3:43"), 2: ("q", "0:40")}
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.repeated_strings(df, with_text=True).collect()}
    assert got == {1: rows[0][1].encode(), 2: b" q"}
