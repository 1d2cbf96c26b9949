"""Substring deduplication by fixed-block anchors.

A window of ``width`` words holds a whole block of (width + 1) // 2 words of
any document's grid.  So the non-overlapping blocks of all documents are
indexed, every rolling block probes the index, and only windows around a hit
can repeat.  Hits are extended by comparing the windows that contain them;
runs of repeated windows are the maximal exact repeats.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import (EXCHANGE_SCHEMA, Keys, bit_answers, buckets_for, carry, covered, docs_body,
                               docs_from, exchange, meet, numbered, per_chunk, rolling, spans_of, stable, text_bytes,
                               together, unpack, pack, word_hashes)

_FINAL = "row long, id long, n_words long, n_removed long, kept_sha256 string, spans string, kept binary"


def _doc_numbers(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, place of the word in its document)."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _windows(sizes: np.ndarray, width: int) -> np.ndarray:
    """Places of the words at which a whole window of one document starts."""
    doc, place = _doc_numbers(sizes)
    return np.flatnonzero(place + width <= sizes[doc]) if len(doc) else np.zeros(0, np.int64)


def _block_keys(texts: list[bytes], width: int, block: int, buckets: int, bits: int):
    units, sizes = word_hashes(texts)
    at = _windows(sizes, block)
    hashes = rolling(units, block, 1)[at] if len(at) else np.zeros(0, np.uint64)
    _, place = _doc_numbers(sizes)
    return units, sizes, at, place[at] % block == 0, Keys(hashes, buckets, bits)


def _final(row, i, text: bytes, gone: np.ndarray | None, whole: bool) -> tuple:
    words = text.split()
    if gone is None or not gone.any():
        kept, spans, n = words, "", 0
    else:
        starts, ends = spans_of(gone)
        spans, n = ",".join(f"{a}:{b}" for a, b in zip(starts, ends)), int(gone.sum())
        kept = [w for w, g in zip(words, gone.tolist()) if not g]
    joined = b" ".join(kept)
    return int(row), i, len(words), n, hashlib.sha256(joined).hexdigest(), spans, joined if whole else None


def _repeats(parts: list[dict], order, group, size) -> np.ndarray:
    many = np.concatenate([np.unpackbits(p["many"], count=len(p["steps"])) for p in parts])[order].astype(bool)
    return (size[group] > 1) | (np.bincount(group, many, len(size))[group] > 0)


def repeated_windows(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text",
                     with_text: bool = False) -> DataFrame:
    """Removes every word covered by a window of ``width`` words that starts anywhere else too.

    Returns one row per input row: the id, n_words, n_removed, kept_sha256
    (kept words joined by one space, UTF-8), spans (start:end of the removed
    runs, in words) and, on request, the kept text.  Words are runs between
    ASCII white space.  NULL and blank texts have no words; texts shorter than
    a window lose nothing; repeated rows (and repeated or NULL ids) are
    documents of their own, so copies remove each other; other columns are
    dropped.

    Two exchanges of packed keys (see common.py): rolling blocks, then the
    windows around hits.  A key goes to its bucket once per chunk.  Blocks are
    keyed by enough bits for few chance hits, windows by about 63 bits, and a
    window is only compared if its block hit as well.
    """
    docs = stable(numbered(docs, id_col, text_col))
    block = (width + 1) // 2
    words = text_bytes(docs) // 6 + 1
    buckets, bits = buckets_for(words), math.ceil(math.log2(words + 1)) + 13

    def ask(chunk, rows, ids, texts):
        _, _, _, aligned, keys = _block_keys(texts, width, block, buckets, bits)
        for bucket, body in _bodies(keys, many=keys.counts > 1, index=keys.any(aligned)):
            yield bucket, chunk, body

    def find(bodies):
        parts, order, group, size = together(bodies)
        index = np.concatenate([np.unpackbits(p["index"], count=len(p["steps"])) for p in parts])[order]
        indexed = np.bincount(group, index, len(size)) > 0
        return bit_answers(parts, order, _repeats(parts, order, group, size) & indexed[group])

    def extend(chunk, body, got):
        rows, ids, texts = docs_from(body)
        units, sizes, at, _, keys = _block_keys(texts, width, block, buckets, bits)
        hit = np.zeros(len(units) + 1, np.int64)
        hit[at] = keys.answers(got)[keys.inverse]
        hits = np.concatenate(([0], np.cumsum(hit)))
        windows = _windows(sizes, width)
        windows = windows[hits[windows + width - block + 1] > hits[windows]]
        doc, _ = _doc_numbers(sizes)
        mine = np.zeros(len(texts), bool)
        mine[doc[windows]] = True
        for k in np.flatnonzero(~mine).tolist():
            yield (0, chunk, None, None, *_final(rows[k], ids[k], texts[k], None, with_text))
        if mine.any():
            some = np.flatnonzero(mine).tolist()
            keys = Keys(rolling(units, width, 2)[windows], buckets, 60)
            for bucket, body in _bodies(keys, many=keys.counts > 1):
                yield (1, chunk, bucket, body, *[None] * 7)
            # Places among the words of the documents that stay in play.
            shift = np.cumsum(np.where(mine, 0, sizes))
            body = pack(docs=np.frombuffer(docs_body([int(rows[k]) for k in some], [ids[k] for k in some], [texts[k] for k in some]), np.uint8),
                        at=np.diff(windows - shift[doc[windows]], prepend=0).astype(np.int32))
            yield (2, chunk, None, body, *[None] * 7)

    def same(bodies):
        parts, order, group, size = together(bodies)
        return bit_answers(parts, order, _repeats(parts, order, group, size))

    def remove(chunk, body, got):
        held = unpack(body)
        rows, ids, texts = docs_from(held["docs"].tobytes())
        units, sizes = word_hashes(texts)
        windows = np.cumsum(held["at"].astype(np.int64))
        keys = Keys(rolling(units, width, 2)[windows], buckets, 60)
        gone = covered(windows[keys.answers(got)[keys.inverse]], width, len(units))
        ends = np.cumsum(sizes)
        for k, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
            yield _final(rows[k], ids[k], texts[k], gone[end - n:end], with_text)

    answers = exchange(per_chunk(docs, ask, EXCHANGE_SCHEMA), find)
    step = meet(carry(docs), answers, extend, f"kind int, chunk long, bucket int, body binary, {_FINAL}").checkpoint()
    answers = exchange(step.where("kind = 1").select("bucket", "chunk", "body"), same)
    rest = meet(step.where("kind = 2").select("chunk", "body"), answers, remove, _FINAL)
    done = step.where("kind = 0").select(rest.columns).unionAll(rest)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "spans",
                       *[F.col("kept").cast("string").alias("kept")] * with_text)


def _bodies(keys: Keys, **masks: np.ndarray):
    """Bodies with bit masks per key."""
    for k, (bucket, body) in enumerate(keys.bodies()):
        a, b = keys.edges[k], keys.edges[k + 1]
        yield bucket, pack(**unpack(body), **{n: np.packbits(m[a:b]) for n, m in masks.items()})
