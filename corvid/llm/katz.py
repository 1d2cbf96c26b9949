"""Katz backoff language model over words, order two, trained and applied as Spark jobs.

P(w | h) is the discounted relative frequency of a seen pair, and else the
backoff weight of h times the lower-order P(w), which is the discounted
frequency of a seen word, and else the left-over mass of the unknown word.

Discounts are Good-Turing: (r + 1) n(r+1) / (r n(r)) for small counts r, and
for larger ones the same ratio on the log-linear fit of the counts of counts,
which is below one for every r.  So every history has left-over mass, and its
weight, (1 - discounted mass of its seen words) / (1 - lower-order mass of its
seen words), normalises it exactly.

The tables (words, pairs, histories) are partitioned by key hash, of so many
bits that no chance match is expected at any size; see common.py for how
chunks of documents ask them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import (EXCHANGE_SCHEMA, Keys, arrow_fields, buckets_for, carry, docs_from, deltas, key_bits, meet, mix, numbered, pack, per_chunk,
                               stable, text_bytes, together, undeltas, unpack, word_hashes)

#: Counts up to which the plain Good-Turing ratio is used, and counts of counts that the fit uses.
SMALL, FITTED = 5, 20
END, START = np.uint64(0x0E4D), np.uint64(0x57A7)
_STATS = 2 + FITTED + 1
_ANSWERS = "chunk long, bucket int, body binary, " + ", ".join(f"s{k} long" for k in range(_STATS))


def trains(i, held_out: int, of: int) -> bool:
    return zlib.crc32(b"" if i is None else str(i).encode()) % of != held_out


class Discount:
    """Good-Turing factor of a count, from the counts of counts n(1), n(2), ..."""

    def __init__(self, counts_of_counts: list[int]):
        n = {r: c for r, c in enumerate(counts_of_counts, 1) if c > 0}
        x, y = np.log(list(n) or [1.0]), np.log(list(n.values()) or [1.0])
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()) if len(n) > 1 else -2.0
        self.power = min(slope, -1.1) + 1
        self.small = {r: (r + 1) * n[r + 1] / (r * n[r]) for r in range(1, SMALL + 1) if r in n and r + 1 in n}
        self.small = {r: d for r, d in self.small.items() if 0 < d < 1}

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        r = np.maximum(counts, 1).astype(float)
        out = (1 + 1 / r) ** self.power
        for k, d in self.small.items():
            out[counts == k] = d
        return out


class Words:
    """The lower order: probabilities of words by their counts."""

    def __init__(self, total: int, types: int, counts_of_counts: list[int], mass_left: float | None = None):
        self.total, self.types, self.discount, self.left = total, types, Discount(counts_of_counts), mass_left

    def seen(self, counts: np.ndarray) -> np.ndarray:
        return self.discount(counts) * counts / max(1, self.total)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.seen(counts), self.left)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.types + 1))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, history, document): words of the lower-cased texts, each text ended by END and begun after START."""
    units, sizes = word_hashes([t.lower() for t in texts])
    n = sizes + 1
    ends = np.cumsum(n) - 1
    token = np.empty(int(n.sum()), np.uint64)
    word = np.ones(len(token), bool)
    word[ends] = False
    token[word], token[ends] = units, END
    history = np.concatenate(([START], token[:-1]))
    history[ends - n + 1] = START
    return token, history, np.repeat(np.arange(len(texts)), n)


def _pair(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(history) * np.uint64(0x9E3779B97F4A7C15) + token)


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _counted(requests: DataFrame, answer, offset: int, keep: bool) -> DataFrame:
    """Answers of the buckets, and one row per bucket (chunk -1): sums (total, types, counts of counts), and the table if kept."""
    def run(table: pa.Table) -> pa.Table:
        chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        at = np.argsort(np.array(chunks), kind="stable").tolist()
        parts, order, group, size = together([table.column("body")[k].as_py() for k in at])
        counts = np.concatenate([p["count"] for p in parts]).astype(np.int64)[order]
        total = np.add.reduceat(counts, np.cumsum(size) - size)
        bodies = answer(parts, order, group, size, counts, total)
        some = total[total > 0]
        sums = [int(some.sum()), len(some), *np.bincount(some[some <= FITTED + 1], minlength=FITTED + 2)[1:FITTED + 2].tolist()]
        keys = np.concatenate([undeltas(p["steps"]) for p in parts])[order][np.cumsum(size) - size]
        held = pack(steps=deltas(keys[total > 0]), count=_narrow(some)) if keep else b""
        columns = [[chunks[k] for k in at] + [-1], [offset + bucket] * (len(at) + 1), bodies + [held]]
        fields = [x.split()[0] for x in _ANSWERS.split(", ")]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()),
                         *[pa.array([None] * len(at) + [s], pa.int64()) for s in sums]], fields)
    return requests.groupBy("bucket").applyInArrow(run, _ANSWERS).checkpoint()


def _sums(answers: DataFrame) -> list[int]:
    row = answers.where("chunk = -1").agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0)) for k in range(_STATS)]).first()
    return [int(x) for x in row]


def _back(parts: list[dict], order: np.ndarray, **ordered: np.ndarray) -> list[bytes]:
    out, ends = [], np.cumsum([len(p["steps"]) for p in parts])
    arrays = {}
    for name, a in ordered.items():
        arrays[name] = np.empty(len(order), a.dtype)
        arrays[name][order] = a
    for p, e in zip(parts, ends.tolist()):
        b = e - len(p["steps"])
        out.append(pack(n=np.array([e - b]), **{k: _narrow(a[b:e]) if a.dtype.kind == "i" else np.packbits(a[b:e]) if a.dtype == bool else a[b:e]
                                                for k, a in arrays.items()}))
    return out


def _read(keys: Keys, got: dict[int, bytes], offset: int, names: dict[str, type]) -> list[np.ndarray]:
    """Per distinct key, the named arrays of the answers."""
    out = [np.zeros(len(keys.keys), t) for t in names.values()]
    for k, bucket in enumerate(keys.buckets.tolist()):
        a, b = keys.edges[k], keys.edges[k + 1]
        part = unpack(got[offset + bucket])
        if part["n"][0] != b - a:
            raise ValueError("the documents changed between two reads; write them to a table first")
        for o, (name, t) in zip(out, names.items()):
            o[a:b] = np.unpackbits(part[name], count=b - a) if t is bool else part[name]
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, of: int = 7,
          tables: str | None = None) -> DataFrame:
    """Scores every whole text with a model learned from all documents but the held-out ones.

    Returns one row per input row: the id, held_out (crc32 of the id as text
    mod ``of`` is ``held_out``), n_tokens, n_known (tokens that occur in
    training), train_tokens, base_score (add-one unigram) and score, both
    log10.  Tokens are the words between ASCII white space, A-Z lower-cased,
    and one end per text.  NULL and blank texts are the end alone; a NULL id
    hashes as the empty text; repeated rows count each time; without training
    text all tokens are unknown, and an empty table gives no row; other columns
    are dropped.  ``tables`` names a new folder, on a store that all executors
    share, to keep the word and pair tables in: one row per partition, with
    its sorted key hashes and their counts (see common.unpack).
    """
    docs = stable(numbered(docs, id_col, text_col))
    size = text_bytes(docs) // 6 + 1
    word_buckets, pair_buckets = buckets_for(size // 4), buckets_for(size // 2)
    pairs_from = 1 << 28
    word_bits, pair_bits = key_bits(size, word_buckets, 12), key_bits(size, pair_buckets, 2)

    def words(texts):
        token, history, doc = tokens(texts)
        return token, history, doc, Keys(token, word_buckets, word_bits)

    def ask_words(chunk, rows, ids, texts):
        token, _, doc, keys = words(texts)
        train = np.array([trains(i, held_out, of) for i in ids])
        count = np.bincount(keys.inverse, train[doc], len(keys.keys)).astype(np.int64)
        for bucket, body in keys.bodies(count=_narrow(count)):
            yield bucket, chunk, body

    def count_words(parts, order, group, size, counts, total):
        return _back(parts, order, count=total[group])

    one = _counted(per_chunk(docs, ask_words, EXCHANGE_SCHEMA), count_words, 0, True)
    total, types, *ones = _sums(one)
    lower = Words(total, types, ones)
    # Mass of the unknown word: what the discounted counts leave.  Summed over the table of words, not from a formula.
    lower.left = 1.0 if not total else max(1e-12, 1 - _seen_mass(one, lower))

    def pairs(texts, ids, got):
        token, history, doc, keys = words(texts)
        count, = _read(keys, got, 0, {"count": np.int64})
        of_token = count[keys.inverse]
        before = np.concatenate(([0], of_token[:-1]))
        start = history == START
        ends = np.flatnonzero(token == END)
        before[start] = of_token[ends[0]] if len(ends) else 0
        known = np.flatnonzero((of_token > 0) & (before > 0))
        return token, history, doc, of_token, before, known, Keys(_pair(history[known], token[known]), pair_buckets, pair_bits)

    def ask_pairs(chunk, body, got):
        _, ids, texts = docs_from(body)
        token, history, doc, _, _, known, keys = pairs(texts, ids, got)
        train = np.array([trains(i, held_out, of) for i in ids])
        count = np.bincount(keys.inverse, train[doc[known]], len(keys.keys)).astype(np.int64)
        for bucket, out in keys.bodies(count=_narrow(count)):
            yield bucket, chunk, out

    def count_pairs(parts, order, group, size, counts, total):
        # The first chunk that trains on a pair speaks for it when histories add up their pairs.
        place = np.where(counts > 0, np.arange(len(counts)), len(counts))
        first = np.minimum.reduceat(place, np.cumsum(size) - size)
        return _back(parts, order, count=total[group], owner=first[group] == np.arange(len(counts)))

    chunks, answers = carry(docs), one.where("chunk >= 0").select("chunk", "bucket", "body")
    two = _counted(meet(chunks, answers, ask_pairs, EXCHANGE_SCHEMA), count_pairs, pairs_from, bool(tables))
    if tables:
        for name, part in (("words", one), ("pairs", two)):
            part.where("chunk = -1").select("bucket", "body").write.parquet(f"{tables}/{name}")
    discount = Discount(_sums(two)[2:])
    both = answers.unionAll(two.where("chunk >= 0").select("chunk", "bucket", "body"))

    def ask_histories(chunk, body, got):
        rows, ids, texts = docs_from(body)
        token, history, doc, count, before, known, keys = pairs(texts, ids, got)
        pair, owner = _read(keys, got, pairs_from, {"count": np.int64, "owner": bool})
        log = np.log10(lower(count))
        seen = np.zeros(len(token), bool)
        seen[known] = pair[keys.inverse] > 0
        c = pair[keys.inverse][seen[known]]
        log[seen] = np.log10(discount(c) * c / before[seen])
        backs = np.flatnonzero(~seen & (before > 0))
        # One occurrence of each pair that this chunk speaks for.
        first = np.full(len(keys.keys), len(known))
        np.minimum.at(first, keys.inverse, np.arange(len(known)))
        own = known[first[owner]]
        mass, low = discount(pair[owner]) * pair[owner], lower.seen(count[own])
        of_history = Keys(np.concatenate((history[own], history[backs])), word_buckets, word_bits)
        mine, asks = of_history.inverse[:len(own)], of_history.inverse[len(own):]
        n = len(of_history.keys)
        asked = np.bincount(asks, minlength=n) > 0
        times = np.zeros(n, np.int64)
        times[asks] = before[backs]
        for k, (bucket, out) in enumerate(of_history.bodies(mass=np.bincount(mine, mass, n), low=np.bincount(mine, low, n))):
            a, b = of_history.edges[k], of_history.edges[k + 1]
            yield bucket, chunk, pack(**unpack(out), asked=np.packbits(asked[a:b]))
        n_docs = len(texts)
        # The chunk's own row goes through the same shuffle, in a group that is handed on.
        yield -1 - chunk % 1_000_003, chunk, pack(
            null=np.array([i is None for i in ids], np.uint8), id=np.array([0 if i is None else i for i in ids], np.int64),
            tokens=np.bincount(doc, minlength=n_docs), known=np.bincount(doc[count > 0], minlength=n_docs),
            base=np.bincount(doc, lower.base(count), n_docs), score=np.bincount(doc, log, n_docs),
            back=_narrow((np.cumsum(asked) - 1)[asks]), doc=_narrow(doc[backs]), times=_narrow(times[asked]),
            edges=of_history.edges, buckets=of_history.buckets, asked=np.packbits(asked))

    def weigh(table: pa.Table) -> pa.Table:
        chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        if bucket < 0:
            return table.select(["chunk", "bucket", "body"])
        at = np.argsort(np.array(chunks), kind="stable").tolist()
        parts, order, group, size = together([table.column("body")[k].as_py() for k in at])
        start = np.cumsum(size) - size
        mass, low = (np.add.reduceat(np.concatenate([p[x] for p in parts])[order], start)[group] for x in ("mass", "low"))
        back = {x: np.empty(len(order)) for x in ("mass", "low")}
        back["mass"][order], back["low"][order] = mass, low
        bodies, end = [], 0
        for p in parts:
            n = len(p["steps"])
            asked = np.unpackbits(p["asked"], count=n).astype(bool)
            bodies.append(pack(mass=back["mass"][end:end + n][asked], low=back["low"][end:end + n][asked]))
            end += n
        return pa.table([pa.array([chunks[k] for k in at], pa.int64()), pa.array([bucket] * len(at), pa.int32()), pa.array(bodies, pa.binary())],
                        ["chunk", "bucket", "body"])

    weights = meet(chunks, both, ask_histories, EXCHANGE_SCHEMA).groupBy("bucket").applyInArrow(weigh, "chunk long, bucket int, body binary")

    def finish(got):
        held = unpack(next(body for bucket, body in got.items() if bucket < 0))
        asked = np.unpackbits(held["asked"], count=int(held["edges"][-1]) if len(held["edges"]) else 0).astype(bool)
        parts = [unpack(got[b]) for b in held["buckets"].tolist()]
        mass, low = (np.concatenate([p[x] for p in parts]) if parts else np.zeros(0) for x in ("mass", "low"))
        if len(mass) != asked.sum():
            raise ValueError("the documents changed between two reads; write them to a table first")
        back = held["back"].astype(np.int64)
        weight = (np.log10(1 - mass / held["times"]) - np.log10(1 - low))[back]
        total_ = held["score"] + np.bincount(held["doc"].astype(np.int64), weight, len(held["score"]))
        for k, (z, i) in enumerate(zip(held["null"].tolist(), held["id"].tolist())):
            i = None if z else i
            yield i, not trains(i, held_out, of), int(held["tokens"][k]), int(held["known"][k]), total, float(held["base"][k]), float(total_[k])

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names, types = arrow_fields(schema)

    def per_chunk_scores(table: pa.Table) -> pa.Table:
        found = list(finish(dict(zip(table.column("bucket").to_pylist(), table.column("body").to_pylist()))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    done = weights.groupBy("chunk").applyInArrow(per_chunk_scores, schema)
    return done.withColumnRenamed("id", id_col)


def _seen_mass(answers: DataFrame, lower: Words) -> float:
    """Discounted mass of all seen words, added up over the partitions of the word table."""
    def run(batches):
        for batch in batches:
            mass = [float(lower.seen(unpack(b.as_py())["count"].astype(np.int64)).sum()) for b in batch.column("body")]
            yield pa.RecordBatch.from_arrays([pa.array(mass, pa.float64())], ["mass"])
    return answers.where("chunk = -1").select("body").mapInArrow(run, "mass double").agg(F.sum("mass")).first()[0] or 0.0
