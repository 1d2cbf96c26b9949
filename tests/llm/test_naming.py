import hashlib
import re

import duckdb
import pytest

from corvid.llm.naming import exact_groups
from corvid.llm.q_dedup import ORACLE, op1_exact_dedup


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for text, found in groups.items():
        best = min(found)
        for f in found:
            k = f[3]
            out.append((rows[k][0], rows[best[3]][0], len(found), hashlib.sha256(text.encode()).hexdigest(), k == best[3]))
    return sorted(out, key=str)


def got(df, **k):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"], r["kept"]) for r in exact_groups(df, **k).collect()), key=str)


@pytest.mark.parametrize("block", [3, 4096])
def test_odd_rows(spark, block):
    rows = [(None, None), (4, ""), (4, " \t"), (1, "a b"), (2, "ab "), (3, "a\nb"), (None, "é" * 5000 + " x"), (9, "é" * 5000 + "x"), (8, "é" * 4999 + "xx"),
            (5, "abc"), (6, "abcabc"), (7, "abcabcabc"), (7, "abcabcabc"), (10, "abcabcabcabc"), (None, "a b"), (11, "a b"), (12, "a\x1cb")]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, row int, name string").coalesce(1)
    assert got(df, block=block) == brute(rows)
    assert exact_groups(df.limit(0)).collect() == []


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.sql(ORACLE["op1_exact_dedup"]).fetchall())
    assert sorted(map(tuple, op1_exact_dedup(spark, d).collect())) == want
