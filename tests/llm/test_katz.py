import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvid.llm import common, katz
from corvid.llm.q_model import op2_katz_backoff


def model(rows):
    """Katz in dictionaries: (tokens per row, words, P(w | h), scores)."""
    docs = []
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["\0end"]
        docs.append((words, zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2))
    ones = Counter(w for ws, train in docs if train for w in ws)
    twos = Counter(p for ws, train in docs if train for p in zip(["\0start", *ws], ws))
    coc = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.FITTED + 2)]
    total = sum(ones.values())
    d1, d2 = (katz.Discount(coc(c)) for c in (ones, twos))
    f = lambda d, r: float(d(np.array([r]))[0])
    p1 = {w: f(d1, c) * c / total for w, c in ones.items()}
    left = 1 - sum(p1.values()) if total else 1.0
    following = defaultdict(dict)
    for (h, w), c in twos.items():
        following[h][w] = c
    count = lambda h: ones["\0end"] if h == "\0start" else ones[h]

    def p(w, h):
        if not count(h):
            return p1.get(w, left)
        if w in following[h]:
            c = following[h][w]
            return f(d2, c) * c / count(h)
        alpha = (1 - sum(f(d2, c) * c for c in following[h].values()) / count(h)) / (1 - sum(p1[x] for x in following[h]))
        return alpha * p1.get(w, left)

    out = []
    for (i, _), (ws, train) in zip(rows, docs):
        base = sum(math.log10((ones[w] + 1) / (total + len(ones) + 1)) for w in ws)
        out.append((i, not train, len(ws), sum(ones[w] > 0 for w in ws), total, base, sum(math.log10(p(w, h)) for h, w in zip(["\0start", *ws], ws))))
    return out, ones, following, p


def same(got, want):
    got, want = (sorted(map(tuple, x), key=str) for x in (got, want))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_query_against_dictionaries(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = op2_katz_backoff(spark, d).collect()
    same(got, model(rows)[0])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small, tmp_path):
    if small:
        monkeypatch.setattr(common, "CHUNK_BYTES", 300)
        monkeypatch.setattr(common, "BUCKET_KEYS", 20)
    rng = random.Random(2)
    voc = [f"w{k}" for k in range(60)]
    rows = [(None, None), (2, ""), (2, " \n"), (3, "A b a B"), (3, "A b a B"), (4, "é É w1"), (None, "w1 w2"), (5, "w3 " * 4000)]
    rows += [(k, " ".join(voc[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(0, 80)))) for k in range(10, 60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int").repartition(3)
    same(katz.score(df, tables=str(tmp_path / "model")).collect(), model(rows)[0])
    assert {"words", "pairs"} == {p.name for p in (tmp_path / "model").iterdir()}
    assert katz.score(df.limit(0)).collect() == []
    only = df.where("doc_id = 10").limit(1)
    same(katz.score(only, held_out=zlib.crc32(b"10") % 7).collect(), [(10, True, n := len(dict(rows)[10].split()) + 1, 0, 0, 0.0, 0.0)])


def test_normalised(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefghij") for _ in range(30))) for k in range(40)]
    _, ones, following, p = model(rows)
    for h in [*following, "never seen"]:
        assert abs(sum(p(w, h) for w in [*ones, "unknown word"]) - 1) < 1e-9
