"""Helpers shared by the training-data operators.

``numbered`` gives every input row its own key, so that NULL ids, repeated ids
and repeated rows are safe everywhere.  ``carry`` / ``exchange`` / ``meet``
let a task work on many small keys as sorted numpy arrays while Spark does the
partitioning: a *chunk* is a bounded run of documents, a *bucket* a hash range
of keys.  Chunks send one packed row per bucket, each bucket is one group of
one task and answers every chunk, and the answers meet the chunk again.  A key
that a third of all rows hold reaches a bucket once per chunk, so no hot key
exists after the in-chunk aggregation.
"""

from __future__ import annotations

import io
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.ranking import rank_within

#: Unique key of an input row; carried beside the caller's id column.
ROW = "__row"

#: Bytes of text that a chunk gathers at most (one longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20
#: Documents in a chunk at most.
CHUNK_DOCS = 60_000
#: Rows of an Arrow batch that holds texts.
BATCH_ROWS = 1_000
#: Keys that a bucket gets on average.
BUCKET_KEYS = 400_000

CHUNK_SCHEMA = "chunk long, body binary"
EXCHANGE_SCHEMA = "bucket int, chunk long, body binary"


def pin_splits(spark: SparkSession) -> None:
    """From now on the splits of a scan do not follow the cores that are registered when an action starts.

    Left alone, Spark aims at one split per core it has at that moment, so a
    table below ``maxPartitionBytes`` times the cores is split otherwise after
    an executor was lost.  A setting that the caller made is kept.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             row_col: str | None = None) -> DataFrame:
    """(row, id, text) of ``docs``; NULL text is empty, other columns are dropped.

    The row key numbers the rows of the scan.  ``row_col`` names a unique
    long column to use instead.  Texts can be long, so Arrow batches are set to
    fewer rows than Spark's default for this session.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    pin_splits(docs.sparkSession)
    key = F.monotonically_increasing_id() if row_col is None else docs[row_col]
    return docs.select(key.cast("long").alias("row"), docs[id_col].cast("long").alias("id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` if every read gives the same partitions (a scan, narrow steps); else a checkpoint of it."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    wide = re.search(r"\b(Join|Aggregate|Repartition\w*|RebalancePartitions|Sort|Window|Distinct|Deduplicate|Sample|\w*Limit)\b", plan)
    return docs.checkpoint() if wide else docs


def written(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` computed once, as Parquet in the shared folder (a new one): every later read gets the same rows, and Spark knows its size."""
    path = path or scratch(docs.sparkSession, "rows")
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch`` that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a Parquet scan with projections and filters only, so that a row of a file gives one row at most."""
    lines = docs._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    names = [re.match(r"[\s:+|-]*(\w+)", line) for line in lines]
    return all(m and m[1] in ("Project", "Filter", "Relation") for m in names) and lines[-1].rstrip().endswith("parquet")


def row_keys(docs: DataFrame, name: str = ROW) -> DataFrame:
    """``docs`` with a unique long per row that every later read gives again.

    The splits of a scan follow the cores that are registered when an action
    starts, so numbers of a scan's partitions hold for one action only.  A row
    of a Parquet scan is named by its file and its place there; files are
    numbered in a small table, written once.  Any other frame is written.
    """
    if _is_scan(docs):
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
            paths = docs.select(F.col("_metadata.file_path").alias("__path")).distinct()
        except AnalysisException:
            pass
        else:
            # One row a file; a place in a file has 38 bits, so there may be 2^25 files.
            files = written(rank_within(paths, [], ["__path"], "__no"))
            return (placed.join(files, F.col("__file") == F.col("__path"))
                    .select(*docs.columns, (F.expr("shiftleft(__no, 38)") + F.col("__at")).alias(name)))
    return written(docs.withColumn(name, F.monotonically_increasing_id()))


def numbered_once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``numbered`` for more than one read; a caller's ``row_col`` must not depend on the splits."""
    if row_col is None:
        docs, row_col = row_keys(docs), ROW
    return numbered(docs, id_col, text_col, row_col)


def crc_mod(id_column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")), F.lit(divisor))


def pack(level: int = 1, **arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed value."""
    out = io.BytesIO()
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        if a.dtype == np.float64 and a.size:
            # Few distinct numbers: their list, and a place in it for each.
            values, place = np.unique(a, return_inverse=True)
            if values.size <= a.size // 4:
                small = np.uint16 if values.size < 1 << 16 else np.uint32
                _put(out, f"{name}#", values)
                _put(out, f"{name}@", place.astype(small))
                continue
        _put(out, name, a)
    return zstandard.ZstdCompressor(level=level).compress(out.getvalue())


def _put(out: io.BytesIO, name: str, a: np.ndarray) -> None:
    # Planes of equal-weight bytes compress better than whole numbers.
    out.write(f"{name}:{a.dtype.str}:{a.size}\n".encode())
    out.write(a.view(np.uint8).reshape(a.size, a.dtype.itemsize).T.tobytes() if a.size else b"")


def unpack(body: bytes) -> dict[str, np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, {}
    while at < len(raw):
        end = raw.index(b"\n", at)
        name, kind, n = raw[at:end].decode().split(":")
        dtype, n = np.dtype(kind), int(n)
        at = end + 1
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out[name] = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
        at += n * dtype.itemsize
        if name.endswith("@"):
            out[name[:-1]] = out.pop(f"{name[:-1]}#")[out.pop(name)]
    return out


def chunks_of(batches: Iterator[pa.RecordBatch], partition: int) -> Iterator[tuple[int, list, list, list[bytes]]]:
    """(chunk, rows, ids, texts as UTF-8) of one partition, in scan order."""
    rows, ids, texts, held, k = [], [], [], 0, 0
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        for row, i, t in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), text):
            t = t.as_py()
            if rows and (held + len(t) > CHUNK_BYTES or len(rows) >= CHUNK_DOCS):
                yield (partition << 32) + k, rows, ids, texts
                rows, ids, texts, held, k = [], [], [], 0, k + 1
            rows.append(row)
            ids.append(i)
            texts.append(t)
            held += len(t)
    if rows:
        yield (partition << 32) + k, rows, ids, texts


def docs_body(rows: list, ids: list, texts: list[bytes]) -> bytes:
    """The documents of a chunk as one value; a NULL id is kept by a mask."""
    return pack(level=3, row=np.array(rows, np.int64), null=np.array([i is None for i in ids], np.uint8),
                id=np.array([0 if i is None else i for i in ids], np.int64),
                size=np.array([len(t) for t in texts], np.int64),
                text=np.frombuffer(b"".join(texts), np.uint8))


def docs_from(body: bytes) -> tuple[np.ndarray, list, list[bytes]]:
    got = unpack(body)
    ends = np.cumsum(got["size"])
    whole = got["text"].tobytes()
    texts = [whole[b - n:b] for b, n in zip(ends.tolist(), got["size"].tolist())]
    return got["row"], [None if z else i for i, z in zip(got["id"].tolist(), got["null"].tolist())], texts


def _rows(schema: list[str], found: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
         "double": pa.float64(), "boolean": pa.bool_()}


def arrow_fields(schema: str) -> tuple[list[str], list[pa.DataType]]:
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return list(names), [ARROW[t] for t in types]


def per_chunk(numbered_docs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(chunk, rows, ids, texts)`` yields rows of ``schema`` for each chunk of the scan."""
    names, types = arrow_fields(schema)

    def run(batches):
        from pyspark import TaskContext
        for chunk in chunks_of(batches, TaskContext.get().partitionId()):
            found = []
            for x in fn(*chunk):
                found.append(x)
                if len(found) >= 5_000:
                    yield _rows(names, found, types)
                    found = []
            if found:
                yield _rows(names, found, types)

    return numbered_docs.mapInArrow(run, schema)


def carry(numbered_docs: DataFrame) -> DataFrame:
    """The documents as chunk rows, to meet answers with."""
    return per_chunk(numbered_docs, lambda chunk, rows, ids, texts: [(chunk, docs_body(rows, ids, texts))], CHUNK_SCHEMA)


def exchange(requests: DataFrame, fn) -> DataFrame:
    """Answers (chunk, bucket, body): ``fn`` maps the bodies of one bucket to as many answers."""
    names, types = arrow_fields("chunk long, bucket int, body binary")

    def run(table: pa.Table) -> pa.Table:
        chunks, bodies = table.column("chunk").to_pylist(), table.column("body").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        order = np.argsort(np.array(chunks), kind="stable").tolist()
        answers = fn([bodies[i] for i in order])
        return pa.table([pa.array([chunks[i] for i in order], types[0]), pa.array([bucket] * len(order), types[1]),
                         pa.array(answers, types[2])], names)

    return requests.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, body binary")


def meet(chunks: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(chunk, body, {bucket: answer})`` yields rows of ``schema`` for each chunk."""
    names, types = arrow_fields(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_rows(names, [], types)])
        got = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()))
        return pa.Table.from_batches([_rows(names, list(fn(left.column("chunk")[0].as_py(), left.column("body")[0].as_py(), got)), types)])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def buckets_for(keys: int) -> int:
    return max(1, math.ceil(keys / BUCKET_KEYS))


def text_bytes(numbered_docs: DataFrame) -> int:
    """Bytes of all texts (one pass over the text column; one number comes back)."""
    return int(numbered_docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


# -- numpy --------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(units: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Polynomial hashes of every run of ``width`` units (len - width + 1 of them), mixed.

    Runs of 2, 4, 8 ... units are doubled from the last size, so the cost is
    logarithmic in the width.
    """
    if len(units) < width:
        return np.zeros(0, np.uint64)
    base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) & (2**64 - 1)
    power, size, run = base, 1, units.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out, done = run, size
            else:  # what is hashed so far, then this run
                n = len(units) - done - size + 1
                out = out[:n] * np.uint64(power) + run[done:done + n]
                done += size
        if done == width:
            return mix(out[:len(units) - width + 1])
        n = len(units) - 2 * size + 1
        run = run[:n] * np.uint64(power) + run[size:size + n]
        power = power * power & (2**64 - 1)
        size *= 2


def key_parts(hashes: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, key of ``bits`` bits) of 64-bit hashes, from different bits."""
    bucket = ((hashes >> np.uint64(40)).astype(np.uint64) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    return bucket, hashes & np.uint64((1 << bits) - 1)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    """Sorted keys as steps, in the narrowest type."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype(np.uint64)
    top = int(steps.max()) if len(steps) else 0
    return steps.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def undeltas(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask of the places covered by windows of ``width`` at ``starts``."""
    step = np.bincount(starts, minlength=size + 1) - np.bincount(starts + width, minlength=size + 1)
    return np.cumsum(step)[:size] > 0


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SLICE = 1 << 20
_PRIME = 0x9E3779B97F4A7C15
_PRIME_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words per text); words split at ASCII white space.

    A word's hash is its bytes as a polynomial, taken from prefix sums, mixed
    with its length; slices of about a megabyte keep the sums small.
    """
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = _BLANK[buffer]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc_ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    sizes = np.diff(np.searchsorted(starts, doc_ends), prepend=0)
    out, at = np.empty(len(starts), np.uint64), 0
    up, down = _powers(_PRIME, _SLICE + 1), _powers(_PRIME_INVERSE, _SLICE + 1)
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        n = int(ends[to - 1] - base)
        p, q = (up, down) if n <= _SLICE else (_powers(_PRIME, n + 1), _powers(_PRIME_INVERSE, n + 1))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buffer[base:base + n].astype(np.uint64) + np.uint64(1)) * p[:n], dtype=np.uint64)))
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out, sizes


def key_bits(keys: int, buckets: int, spare: int) -> int:
    """Bits of a key, bucket aside, so that among ``keys`` different ones 2 ** -(spare + 1) chance matches are expected, at any size."""
    return min(60, max(24, math.ceil(2 * math.log2(keys + 1)) + spare - (buckets.bit_length() - 1)))


class Keys:
    """Distinct keys of a chunk, dealt to buckets; answers come back in the same order."""

    def __init__(self, hashes: np.ndarray, buckets: int, bits: int):
        bits = min(bits, 64 - max(1, (buckets - 1).bit_length()))
        bucket, key = key_parts(hashes, buckets, bits)
        self.low = np.uint64((1 << bits) - 1)
        joined = (bucket.astype(np.uint64) << np.uint64(bits)) | key
        self.keys, self.inverse, self.counts = np.unique(joined, return_inverse=True, return_counts=True)
        self.buckets = np.unique(self.keys >> np.uint64(bits)).astype(np.int64)
        at = self.buckets.astype(np.uint64) << np.uint64(bits)
        self.edges = np.append(np.searchsorted(self.keys, at), len(self.keys))

    def smallest(self, values: np.ndarray) -> np.ndarray:
        """Per distinct key, the smallest of its values."""
        out = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(out, self.inverse, values)
        return out

    def any(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.inverse[mask], minlength=len(self.keys)) > 0

    def bodies(self, **per_key: np.ndarray):
        """(bucket, body) of each bucket that gets a key."""
        for k, bucket in enumerate(self.buckets.tolist()):
            a, b = self.edges[k], self.edges[k + 1]
            yield bucket, pack(steps=deltas(self.keys[a:b] & self.low), **{n: v[a:b] for n, v in per_key.items()})

    def answers(self, got: dict[int, bytes]) -> np.ndarray:
        """One bit per distinct key."""
        out = np.zeros(len(self.keys), bool)
        for k, bucket in enumerate(self.buckets.tolist()):
            a, b = self.edges[k], self.edges[k + 1]
            answer = unpack(got[bucket])
            if answer["n"][0] != b - a:
                raise ValueError("the documents changed between two reads; write them to a table first")
            out[a:b] = np.unpackbits(answer["bits"], count=b - a).astype(bool)
        return out


def together(bodies: list[bytes]) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    """(parts, order, group of each ordered key, size of each group) of the keys of one bucket."""
    parts = [unpack(b) for b in bodies]
    keys = np.concatenate([undeltas(p["steps"]) for p in parts])
    order = np.argsort(keys, kind="stable")
    start = runs(keys[order])
    size = np.diff(np.append(start, len(keys)))
    return parts, order, np.repeat(np.arange(len(start)), size), size


def bit_answers(parts: list[dict], order: np.ndarray, ordered_bits: np.ndarray) -> list[bytes]:
    back = np.empty(len(order), bool)
    back[order] = ordered_bits
    ends = np.cumsum([len(p["steps"]) for p in parts])
    return [pack(n=np.array([len(p["steps"])]), bits=np.packbits(back[e - len(p["steps"]):e])) for p, e in zip(parts, ends)]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under spark.checkpoint.dir, which the driver and all executors share."""
    top = spark.sparkContext.getCheckpointDir()
    if not top:
        raise ValueError("set spark.checkpoint.dir")
    return f"{top}/{name}-{uuid.uuid4()}"
