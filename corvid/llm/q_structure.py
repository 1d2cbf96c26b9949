"""Queries of the manifest, run-detection and chat operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.chat import format_chats, log_of_turns, read_back
from corvid.llm.manifest import manifest
from corvid.llm.periods import periodic_runs

#: Texts of conversation -7: the template's own control strings.
ODD = r"\### Assistant: </turn> ok"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), loop=True)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(log_of_turns(turns.unionAll(odd))))


QUERIES = {f.__name__: f for f in (op11_merkle_manifest, op12_periodic_runs, op13_chat_formatting)}

_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LEAF = lambda text: f"sha256({' || '.join(_FIELD(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
OP11_SQL = f"""
WITH RECURSIVE
bits(i, k, c) AS (  -- crc32 of each byte
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, lang, {_LEAF('text')} AS leaf, {_LEAF('lower_text')} AS low,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS h
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents), crc),
l AS (
  SELECT doc_id, lang, leaf, CASE WHEN h % 3 = 0 THEN low ELSE leaf END AS hash,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM d),
up(lang, h, pos, n, digest) AS (
  SELECT lang, 0, pos, n, leaf FROM l
  UNION ALL SELECT lang, h + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, h, pos // 8),
subroots AS (
  SELECT lang, h AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
tops(h, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL SELECT h + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY h, pos // 8),
-- Every run on every leaf's path, by height: the tree's own, then those above its subroot.
nodes AS (
  SELECT l.lang, l.pos, u.h, u.pos AS child, u.pos = l.pos // CAST(pow(8, u.h) AS BIGINT) AS own, u.digest
  FROM l JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.n > 1 AND u.pos // 8 = l.pos // CAST(pow(8, u.h + 1) AS BIGINT)
  UNION ALL
  SELECT l.lang, l.pos, s.height + t.h, t.pos, t.pos = s.pos // CAST(pow(8, t.h) AS BIGINT), t.digest
  FROM l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON t.n > 1 AND t.pos // 8 = s.pos // CAST(pow(8, t.h + 1) AS BIGINT)),
proofs AS (SELECT lang, pos, string_agg(digest, '' ORDER BY h, child) FILTER (WHERE NOT own) AS siblings FROM nodes GROUP BY lang, pos),
fold(lang, pos, h, hash) AS (
  SELECT lang, pos, 0, hash FROM l
  UNION ALL
  SELECT f.lang, f.pos, f.h + 1, sha256(string_agg(CASE WHEN own THEN f.hash ELSE digest END, '' ORDER BY child))
  FROM fold f JOIN nodes n ON n.lang IS NOT DISTINCT FROM f.lang AND n.pos = f.pos AND n.h = f.h GROUP BY f.lang, f.pos, f.h),
ends AS (SELECT lang, pos, max_by(hash, h) AS folded_root FROM fold GROUP BY lang, pos)
SELECT doc_id, leaf, subroot, digest AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = digest AS verified
FROM l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.pos = l.pos
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos, (SELECT digest FROM tops WHERE n = 1) r"""

_ESCAPED = lambda c: rf"replace(replace(replace({c}, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')"
OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{ODD}'), (-7, 1, 'assistant', '{ODD}')),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
         CAST(sum(length('### ' || {_ESCAPED("replace(replace(role, '%', '%25'), ':', '%3A')")} || ': ' || {_ESCAPED('text')} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g"""

ORACLE = {"op11_merkle_manifest": OP11_SQL, "op13_chat_formatting": OP13_SQL}
