import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corvid.llm.packing import pack_sequences, plan
from corvid.llm.q_packing import op10_best_fit_packing, tokenizer_path

SCHEMA = "doc_id long, text string, part int, row string"


def check_packing(rows, texts, max_len=2048, fill=1.02):
    tok = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, docs in want.items():
        pieces = [(k, s, len(d[s:s + max_len]), zlib.crc32(d[s:s + max_len].tobytes())) for d in docs for k, s in enumerate(range(0, len(d), max_len))]
        assert sorted(pieces) == sorted(got[i])
    assert set(want) == set(got)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= max_len
    total = sum(r["length"] for r in rows)
    assert len(bins) <= max(1, -(-total // max_len)) * fill + 1


def test_query_is_whole_and_tight(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check_packing(op10_best_fit_packing(spark, d).collect(), texts)


def test_odd_rows(spark):
    texts = [(None, None), (1, ""), (1, ""), (2, " \n\t "), (3, "A's it B <|endoftext|>x é ́"), (4, "word " * 5000), (5, "İΣ x\x1cy  z")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], SCHEMA)
    check_packing(pack_sequences(df, tokenizer_path()).collect(), texts, fill=2)
    out = pack_sequences(df, tokenizer_path(), with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in out)
    assert pack_sequences(df.limit(0), tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = {int(n): int(c) for n, c in zip(rng.integers(1, 65, 40), rng.integers(1, 500, 40))}
    used = defaultdict(int)
    for need, times in plan(hist, 64):
        assert times > 0 and sum(n * c for n, c in need.items()) <= 64
        for n, c in need.items():
            used[n] += c * times
    assert used == hist
