import hashlib
import zlib

import duckdb
import pytest

from corvid.llm import manifest as m
from corvid.llm.q_structure import OP11_SQL, op11_merkle_manifest

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def climb(tree, at, value):
    proof = ""
    for nodes in tree[:-1]:
        first = at // 8 * 8
        run = nodes[first:first + 8]
        proof += "".join(d for k, d in enumerate(run) if k != at - first)
        value = sha("".join(value if k == at - first else d for k, d in enumerate(run)))
        at //= 8
    return proof, value


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = mine, levels([leaf(r) for r in mine])
    top = levels([trees[g][1][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        mine, tree = trees[g]
        for at, r in enumerate(mine):
            low = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0
            value = leaf((*r[:4], r[4] and r[4].translate(LOWER))) if low else leaf(r)
            p, v = climb(tree, at, value)
            q, v = climb(top, k, v)
            out.append((r[0], leaf(r), tree[-1][0], top[-1][0], sha(p + q), v, v == top[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int")
    return df.repartition(3)


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    got = op11_merkle_manifest(spark, d)
    assert got.columns == con.sql(OP11_SQL).columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(con.sql(OP11_SQL).fetchall(), key=str) and {r[6] for r in rows} == {True, False}
    assert rows == plain([tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()])


ODD = [(1, "a", "en", 1, "Text A"), (1, "a", "en", 1, "Text A"), (None, None, None, None, None), (None, "s", "en", 2, "Null ID"), (2, "b", None, 0, ""), (3, "c", "", 5, "ÄB" * 40_000),
       (4, "ü:-", "ü", 7, "-"), (5, None, "z", None, None), (-9, "b", "en", 3, "neg")]
MANY = [(k, f"s{k % 7}", f"l{k % 11}" if k % 3 else "hot", k, f"Text {k}") for k in range(700)]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], ODD[:2], ODD[2:3] * 9, [(k, "s", f"l{k:03}", 1, "T") for k in range(70)], MANY, ODD + MANY])
def test_against_plain(spark, rows):
    assert sorted(map(tuple, m.manifest(table(spark, rows)).collect()), key=str) == plain(rows)


def test_empty(spark):
    got = m.manifest(table(spark, ODD).limit(0))
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_small_blocks(spark, monkeypatch):
    """Blocks of one run: high nodes serve very many blocks, and nearly all siblings are a block's."""
    monkeypatch.setattr(m, "BASE", 1)
    monkeypatch.setattr(m, "BLOCK", 8)
    assert sorted(map(tuple, m.manifest(table(spark, MANY)).collect()), key=str) == plain(MANY)
