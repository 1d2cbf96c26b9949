"""Best-fit packing by minimum bin slack.

Per bin the longest remaining piece is placed, then a subset-sum dynamic
program over the remaining lengths (one bit per reachable fill) finds the
fullest feasible combination, which is removed.  Pieces of one length are
interchangeable, so the search runs over the histogram of lengths (at most
``max_len`` entries): a combination is applied as often as its lengths last,
every application uses up at least one length, and the plan has at most
``max_len`` entries however many documents there are.  Pieces then find their
place by their rank within their length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import numbered

#: Word pieces, and words that are not plain, that a worker remembers the ids of.
CACHE = 800_000

# Texts of these characters are cut here: their normal form is their lower case, and letter runs, single digits
# and runs of other signs are the tokenizer's own pieces.  Words with any other character go to the tokenizer whole.
_PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!\"#$%&()*+,\-./:;=?@\[\]^_`{}~\\\x20\x09-\x0D]*")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x20\x09-\x0D]+")


_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def byte_letters() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}


def cuts_like(tokenizer_path: str) -> bool:
    """Does this tokenizer cut words as _PLAIN and _PIECE do?  (Lower case, letter runs, single digits, byte level.)"""
    import json

    from tokenizers import Tokenizer
    with open(tokenizer_path) as f:
        spec = json.load(f)
    parts = json.dumps([spec.get(k) for k in ("normalizer", "pre_tokenizer")])
    cut = Tokenizer.from_file(tokenizer_path).pre_tokenizer
    return (all(x in parts for x in ("NFC", "Lowercase", "ByteLevel")) and "Metaspace" not in parts
            and [p for p, _ in cut.pre_tokenize_str("ab12.,_c-d")] == ["ab", "1", "2", ".,_", "c", "-", "d"])


class Encoder:
    """Ids (little-endian unsigned 32 bits) of texts, remembering the ids of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer, self.fast = Tokenizer.from_file(path), cuts_like(path)
        self.pieces: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.letters = byte_letters()

    def __call__(self, text: str) -> bytes:
        if self.fast and _PLAIN.fullmatch(text):
            return self.plain(text)
        words = [w for w in _BLANK.split(text) if w]
        odd = words if not self.fast else [w for w in words if not _PLAIN.fullmatch(w)]
        if len(self.odd) > CACHE:
            self.odd.clear()
        unseen = [w for w in dict.fromkeys(odd) if w not in self.odd]
        for at in range(0, len(unseen), 10_000):
            part = unseen[at:at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                self.odd[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return b"".join([self.odd[w] if w in self.odd else self.plain(w) for w in words])

    def plain(self, text: str) -> bytes:
        pieces, known = _PIECE.findall(text.lower()), self.pieces
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        tokenize = self.tokenizer.model.tokenize
        for p in set(pieces).difference(known):
            seen = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
            ids = [x.id for x in tokenize(seen)]
            known[p] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, pieces))


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int, with_ids: bool) -> DataFrame:
    """(row, id, piece, start, length, crc[, ids]) of (row, id, text).

    Pieces of words are encoded once per worker and joined: the tokenizer turns
    white space into token breaks, so a text's ids are its words' ids in order.
    A tokenizer that merges over spaces is not supported.
    """
    schema = "row long, id long, piece int, start long, length long, crc long" + ", ids binary" * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end, step = Encoder(tokenizer_path), struct.pack("<I", end_id), 4 * max_len
        for batch in batches:
            found = []
            for row, i, t in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                ids = encode(t.as_py()) + end
                found += [(row, i, k, at // 4, len(p := ids[at:at + step]) // 4, zlib.crc32(p)) + ((p,) if with_ids else ())
                          for k, at in enumerate(range(0, len(ids), step))]
                if len(found) >= 10_000:
                    yield table(found)
                    found = []
            if found:
                yield table(found)

    def table(found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return docs.mapInArrow(run, schema)


def fullest(counts: np.ndarray, lengths: list[int], room: int) -> list[int]:
    """Lengths (descending, repeats included) that fill ``room`` as far as possible."""
    reach, came, mask = 1, {}, (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        left, k = min(int(counts[n]), room // n), 1
        while left > 0:
            k = min(k, left)
            new = (reach << (n * k)) & mask & ~reach
            reach |= new
            while new:
                top = new.bit_length() - 1
                came[top] = (n, k)
                new ^= 1 << top
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    while at:
        n, k = came[at]
        out += [n] * k
        at -= n * k
    return out


def plan(histogram: dict[int, int], max_len: int) -> list[tuple[dict[int, int], int]]:
    """[(lengths of one bin with their counts, how many such bins)]."""
    counts = np.zeros(max_len + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    out, lengths = [], [n for n in range(max_len, 0, -1) if counts[n]]
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        bin_ = [seed, *fullest(counts, lengths, max_len - seed)]
        counts[seed] += 1
        need = {n: bin_.count(n) for n in dict.fromkeys(bin_)}
        times = min(int(counts[n]) // c for n, c in need.items())
        for n, c in need.items():
            counts[n] -= c * times
        out.append((need, times))
        lengths = [n for n in lengths if counts[n]]
    return out


def places(bins: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, pieces per bin, first bin, offset) of each entry of the plan."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for need, times in bins:
        offset = 0
        for n, c in need.items():
            found.setdefault(n, []).append((used.get(n, 0), c, first, offset))
            used[n] = used.get(n, 0) + c * times
            offset += n * c
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*v)) for n, v in found.items()}


def pack_sequences(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``max_len`` tokens.

    Returns one row per piece: the id, piece (from 0), start, length, the
    crc32 of its ids, sequence_id, offset and, on request, the ids as
    little-endian unsigned 32-bit numbers.  A document is its ids, then
    ``end_id``; only longer ones are cut, into full pieces and a rest.  NULL
    and empty texts are the end id alone; NULL ids, repeated ids and repeated
    rows are documents of their own; an empty table gives no row; other
    columns are dropped.

    One histogram of lengths (at most ``max_len`` numbers) reaches the driver.
    Ranks within a length are counted per partition and offset by the counts of
    the partitions before, so a length that most documents have is dealt over
    all tasks.
    """
    pieces = tokenised(numbered(docs, id_col, text_col), tokenizer_path, end_id, max_len, with_ids).checkpoint()
    pieces = pieces.withColumn("part", F.spark_partition_id())
    counts = pieces.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    where = places(plan(histogram, max_len))
    within = Window.partitionBy("part", "length").orderBy("row", "piece")
    ranked = (pieces.withColumn("rank", F.row_number().over(within) - 1)
              .join(counts, ["part", "length"])
              .select("id", "piece", "start", "length", "crc", *["ids"] * with_ids, (F.col("base") + F.col("rank")).alias("rank")))

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == n)
                starts, per, first, at = where[n]
                k = np.searchsorted(starts, ranks[mine], "right") - 1
                over = ranks[mine] - starts[k]
                sequence[mine] = first[k] + over // per[k]
                offset[mine] = at[k] + over % per[k] * n
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)],
                                             [*keep, "sequence_id", "offset"])

    schema = f"id long, piece int, start long, length long, crc long{', ids binary' * with_ids}, sequence_id long, offset long"
    return (ranked.mapInArrow(place, schema)
            .withColumnsRenamed({"id": id_col, "crc": "ids_crc32"}))
