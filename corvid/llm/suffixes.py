"""Depth-limited radix sort of suffixes: exact repeated byte strings across documents.

Suffixes are ordered only through the first ``width`` bytes, in passes from
the most significant digit on; a group that holds one document leaves the sort
after each pass, and groups equal to the last digit are the repeated strings.

Only one digit per run of suffixes is dealt: the first digit of a suffix is
the smallest hashed ``gram`` of its first ``width`` bytes, which neighbouring
suffixes share and which equal strings have at the same offset.  The second
digit is the whole stretch of text that such a run of suffixes covers; equal
stretches settle all their suffixes at once.  Only suffixes of a first digit
with several stretches go on to the last digit, the string itself.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import (EXCHANGE_SCHEMA, Keys, bit_answers, buckets_for, carry, covered, deltas, docs_from, exchange,
                               key_parts, meet, mix, numbered, pack, per_chunk, rolling, runs, spans_of, stable, text_bytes,
                               together, undeltas, unpack)

#: Bytes hashed at once.
SLICE = 1 << 18
_LAST = np.iinfo(np.int64).max
_FINAL = "row long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, kept binary"


def _ids(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids ascending, rank of each document's id); NULL comes last."""
    return np.unique(np.array([_LAST if i is None else i for i in ids], np.int64), return_inverse=True)


def _slices(n: int, width: int):
    for a in range(0, max(0, n - width + 1), SLICE):
        yield a, min(n, a + SLICE + width - 1)


def _leftmost_min(h: np.ndarray, span: int) -> np.ndarray:
    """For each start, the place of the leftmost smallest of ``span`` values."""
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < span:
        step = min(size, span - size)
        left, right = value[:len(value) - step], value[step:]
        take = right < left
        value, place = np.where(take, right, left), np.where(take, place[step:], place[:len(place) - step])
        size += step
    return place


class Runs:
    """Runs of suffixes of one document that share their first digit."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        lo, hi, digit, first, last = [], [], [], [], []
        for a, b in _slices(len(self.flat), width):
            part = self.flat[a:b]
            grams = rolling(part, gram, 3)
            anchor = _leftmost_min(grams, width - gram + 1)
            starts = np.arange(a, a + len(anchor))
            doc = np.searchsorted(ends, starts, "right")
            whole = starts + width <= ends[doc]
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))) & whole
            begin = np.flatnonzero(new)
            stop = np.flatnonzero(np.concatenate((new[1:] | ~whole[1:], [True])) & whole)
            strings = rolling(part, width, 4)
            lo.append(a + begin)
            hi.append(a + stop)
            digit.append(mix(grams[anchor[begin]]))   # smallest hashes are small numbers; mixed, they deal evenly
            first.append(strings[begin])
            last.append(strings[stop])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.lo, self.hi, self.digit = join(lo, np.int64), join(hi, np.int64), join(digit, np.uint64)
        self.stretch = stretch(join(first, np.uint64), join(last, np.uint64), self.hi - self.lo)
        self.doc = np.searchsorted(ends, self.lo, "right")


def stretch(first: np.ndarray, last: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Hash of the text from the first string to the end of the last one (they overlap)."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(last + steps.astype(np.uint64)))


def strings_at(flat: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the strings that start at sorted places."""
    out = np.empty(len(places), np.uint64)
    for a, b in _slices(len(flat), width):
        x, y = np.searchsorted(places, (a, a + SLICE))
        if y > x:
            out[x:y] = rolling(flat[a:b], width, 4)[places[x:y] - a]
    return out


def _ask(keys: Keys, ranks: np.ndarray, names: np.ndarray, **per_key: np.ndarray):
    """Bodies with the smallest document of each key."""
    low = keys.smallest(ranks)
    small = np.uint16 if len(names) < 1 << 16 else np.uint32
    for k, (bucket, body) in enumerate(keys.bodies(**per_key)):
        a, b = keys.edges[k], keys.edges[k + 1]
        used, low_at = np.unique(low[a:b], return_inverse=True)
        yield bucket, pack(**unpack(body), names=deltas((names[used] ^ np.int64(-2**63)).view(np.uint64)), low=low_at.astype(small))


def _lowest(parts: list[dict]) -> np.ndarray:
    return np.concatenate([(undeltas(p["names"]).view(np.int64) ^ np.int64(-2**63))[p["low"]] for p in parts])


def _earlier(bodies: list[bytes]) -> list[bytes]:
    """Answers: does a document before the asking chunk's first one hold the key?"""
    parts, order, group, size = together(bodies)
    low = _lowest(parts)[order]
    return bit_answers(parts, order, np.minimum.reduceat(low, np.cumsum(size) - size)[group] < low)


class Digits:
    """Distinct (first digit, stretch) pairs of a chunk; keys are the digits, once per stretch."""

    def __init__(self, found: Runs, buckets: int, bits: int):
        self.stretch, self.inverse = np.unique(found.stretch, return_inverse=True)
        digit = np.zeros(len(self.stretch), np.uint64)
        digit[self.inverse] = found.digit       # a stretch has one first digit
        bucket, key = key_parts(digit, buckets, bits)
        self.order = np.lexsort((self.stretch, key, bucket))
        self.bucket, self.key, self.stretch = bucket[self.order], key[self.order], self.stretch[self.order]
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        self.inverse = place[self.inverse]
        self.edges = np.append(runs(self.bucket), len(self.bucket))

    def ask(self, ranks: np.ndarray, names: np.ndarray):
        low = np.full(len(self.key), _LAST)
        np.minimum.at(low, self.inverse, ranks)
        small = np.uint16 if len(names) < 1 << 16 else np.uint32
        for a, b in zip(self.edges, self.edges[1:]):
            used, low_at = np.unique(low[a:b], return_inverse=True)
            part = self.stretch[a:b] & np.uint64((1 << 48) - 1)
            yield int(self.bucket[a]), pack(steps=deltas(self.key[a:b]), short=part.astype(np.uint32), rest=(part >> np.uint64(32)).astype(np.uint16),
                                            names=deltas((names[used] ^ np.int64(-2**63)).view(np.uint64)), low=low_at.astype(small))

    def answers(self, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per pair: is its stretch in an earlier document, are its suffixes still open?"""
        out = np.zeros((2, len(self.key)), bool)
        for a, b in zip(self.edges, self.edges[1:]):
            answer = unpack(got[int(self.bucket[a])])
            if answer["n"][0] != b - a:
                raise ValueError("the documents changed between two reads; write them to a table first")
            out[0, a:b], out[1, a:b] = (np.unpackbits(answer[x], count=b - a) for x in ("closed", "open"))
        return out


def _digit_answers(bodies: list[bytes]) -> list[bytes]:
    """Per (digit, stretch): closed if an earlier document than the chunk's first has it; open if the digit has other stretches too."""
    parts = [unpack(b) for b in bodies]
    keys = np.concatenate([undeltas(p["steps"]) for p in parts])
    part = np.concatenate([p["short"].astype(np.uint64) | p["rest"].astype(np.uint64) << np.uint64(32) for p in parts])
    low = _lowest(parts)
    order = np.lexsort((part, keys))
    keys, part, low = keys[order], part[order], low[order]
    new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
    new = new_key | np.concatenate(([True], part[1:] != part[:-1]))
    pair, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    first = np.minimum.reduceat(low, np.flatnonzero(new))
    closed = first[pair] < low
    several = np.bincount(group[new]) > 1
    back = np.empty((2, len(order)), bool)
    back[:, order] = closed, several[group]
    out, end = [], 0
    for p in parts:
        n = len(p["steps"])
        out.append(pack(n=np.array([n]), closed=np.packbits(back[0, end:end + n]), open=np.packbits(back[1, end:end + n])))
        end += n
    return out


def _seen_before(keys: Keys, ranks: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
    """Per occurrence: does a document with a smaller id hold its key?"""
    return keys.answers(got)[keys.inverse] | (keys.smallest(ranks)[keys.inverse] < ranks)


def _final(row, i, text: bytes, gone: np.ndarray | None, whole: bool) -> tuple:
    if gone is None or not gone.any():
        kept, spans, n, k = text, "", 0, 0
    else:
        starts, ends = spans_of(gone)
        kept, n, k = np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), len(starts)
        spans = ",".join(f"{a}:{b}" for a, b in zip(starts, ends))
    return int(row), i, len(text), n, k, hashlib.sha256(kept).hexdigest(), spans, kept if whole else None


def repeated_strings(docs: DataFrame, width: int = 50, gram: int = 24, id_col: str = "doc_id", text_col: str = "text",
                     with_text: bool = False) -> DataFrame:
    """Removes every byte covered by a ``width``-byte string that starts in a document with a smaller id too.

    Returns one row per input row: the id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 (remaining bytes), spans (start:end in
    bytes) and, on request, the kept bytes.  NULL text is empty; documents
    shorter than ``width`` lose nothing; a NULL id counts as larger than all
    others; rows of equal id do not remove each other's bytes; other columns
    are dropped.

    Two exchanges of packed keys (see common.py), each dealt over hash buckets
    after a per-chunk aggregation, so a string that most documents hold
    reaches its bucket once per chunk and stretch.  Whole strings have keys of
    about 63 bits, stretches of 48 on top of an equal first digit.
    """
    if not 0 < gram <= width:
        raise ValueError("gram: 1 to width")
    docs = stable(numbered(docs, id_col, text_col))
    digits = text_bytes(docs) * 2 // (width - gram + 2) + 1
    buckets, bits = buckets_for(digits), math.ceil(math.log2(digits + 1)) + 13
    strings_from = 1 << 28

    def ask(chunk, rows, ids, texts):
        names, rank = _ids(ids)
        found = Runs(texts, width, gram)
        for bucket, body in Digits(found, buckets, bits).ask(rank[found.doc], names):
            yield bucket, chunk, body

    def settle(texts, rank, got):
        """(runs, rank of each, closed, places of the open suffixes, the run of each place)."""
        found = Runs(texts, width, gram)
        pairs = Digits(found, buckets, bits)
        closed, several = pairs.answers(got)
        ranks = rank[found.doc]
        low = np.full(len(pairs.key), _LAST)
        np.minimum.at(low, pairs.inverse, ranks)
        closed = closed[pairs.inverse] | (low[pairs.inverse] < ranks)
        left = np.flatnonzero(several[pairs.inverse] & ~closed)
        places, of = _places(found.lo[left], found.hi[left])
        return found, ranks, closed, places, left[of]

    def ask_strings(chunk, body, got):
        _, ids, texts = docs_from(body)
        names, rank = _ids(ids)
        found, ranks, _, places, of = settle(texts, rank, got)
        if len(places):
            for bucket, out in _ask(Keys(strings_at(found.flat, places, width), buckets, 60), ranks[of], names):
                yield bucket, chunk, out

    def remove(chunk, body, got):
        rows, ids, texts = docs_from(body)
        _, rank = _ids(ids)
        found, ranks, closed, places, of = settle(texts, rank, got)
        gone = _cover(found.lo[closed], found.hi[closed], width, len(found.flat))
        if len(places):
            keys = Keys(strings_at(found.flat, places, width), buckets, 60)
            answers = {k - strings_from: v for k, v in got.items() if k >= strings_from}
            gone |= covered(places[_seen_before(keys, ranks[of], answers)], width, len(found.flat))
        at = 0
        for k, t in enumerate(texts):
            yield _final(rows[k], ids[k], t, gone[at:at + len(t)], with_text)
            at += len(t)

    chunks = carry(docs)
    answers = exchange(per_chunk(docs, ask, EXCHANGE_SCHEMA), _digit_answers).checkpoint()
    strings = exchange(meet(chunks, answers, ask_strings, EXCHANGE_SCHEMA), _earlier)
    both = answers.unionAll(strings.select("chunk", (F.col("bucket") + strings_from).alias("bucket"), "body"))
    done = meet(chunks, both, remove, _FINAL)
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_text)


def _places(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(every place of the runs, its run)."""
    size = hi - lo + 1
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


def _cover(lo: np.ndarray, hi: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the bytes under runs of strings."""
    step = np.zeros(n + 1, np.int32)
    step += np.bincount(lo, minlength=n + 1).astype(np.int32)
    step -= np.bincount(hi + width, minlength=n + 1).astype(np.int32)
    return np.cumsum(step)[:n] > 0
