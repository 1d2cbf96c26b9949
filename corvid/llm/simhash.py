"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into segments; the bit counts of the segments are a point
of a small grid.  A changed bit moves one count by one, so the Manhattan
distance of two points never exceeds the Hamming distance of the fingerprints:
a range join on the grid misses no link.  Points within distance d share a grid
point within d/2 of both, so each fingerprint is dealt to its own point and
its neighbours, and the fingerprints of a grid point are verified exactly.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import mix, numbered
from corvid.llm.components import components

#: Segments of a 64-bit fingerprint.
SEGMENTS = 16
#: Fingerprints of one grid point that are compared one by one; more go by shared bit flips, with the same links.
DIRECT = 64


def fingerprint_of(text: str, shingle: int) -> int:
    """64 majority bits of the shingles' XXH64 (seed 42), unsigned."""
    import xxhash
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, id, fp) of (row, id, text); fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint_of(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(fps.view(np.int64))],
                                             ["row", "id", "fp"])

    return docs.mapInArrow(run, "row long, id long, fp long")


def grid_cells(fps: np.ndarray, radius: int, segments: int) -> np.ndarray:
    """Hashes of the grid points within ``radius`` of each fingerprint's point, one row per fingerprint."""
    width = 64 // segments
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(len(fps), segments, width).sum(2, dtype=np.int64)
    # A linear form of the counts, mixed: neighbours differ by sums of the weights.
    weights = mix(np.arange(1, segments + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = (counts.astype(np.uint64) * weights).sum(1, dtype=np.uint64)
    moves, step = {(0,) * segments}, [(0,) * segments]
    for _ in range(radius):
        step = [tuple(v + s * (j == k) for j, v in enumerate(m)) for m in step for k in range(segments) for s in (1, -1)]
        moves.update(step)
    shift = np.array(sorted(moves), np.int64).astype(np.uint64) @ weights
    return mix(own[:, None] + shift[None, :])


def links_in_cells(cells: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints of equal cells; enough of them to connect all that are near.

    Small cells are compared pair by pair.  In a larger one, fingerprints with
    a common point within half the distance (their bit flips) are linked to one of them, so
    the work grows with the cell and not with its square.
    """
    order = np.lexsort((fps, cells))
    cells, fps = cells[order], fps[order]
    new = np.concatenate(([True], cells[1:] != cells[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(cells)))
    of = np.repeat(size, size)
    found = []
    small = np.flatnonzero((of > 1) & (of <= DIRECT))
    if len(small):
        c, f = cells[small], fps[small]
        for lag in range(1, min(DIRECT, len(f))):
            same = np.flatnonzero(c[lag:] == c[:-lag])
            if not len(same):
                break
            a, b = f[same], f[same + lag]
            near = np.bitwise_count(a ^ b) <= distance
            found.append((a[near], b[near]))
    for k in np.flatnonzero(size > DIRECT).tolist():
        f = np.unique(fps[start[k]:start[k] + size[k]])
        flips = np.array([0] + [sum(1 << j for j in js) for r in range(1, (distance + 1) // 2 + 1) for js in combinations(range(64), r)], np.uint64)
        hubs = (f[:, None] ^ flips[None, :]).ravel()
        mine = np.repeat(f, len(flips))
        # The members nearest to a hub come first.  Within half the distance, rounded down, of the hub, the first
        # one is near all others; if it is farther off, every pair that is near meets at another hub.
        away = np.bitwise_count(hubs ^ mine)
        at = np.lexsort((away, hubs))
        hubs, mine, away = hubs[at], mine[at], away[at]
        start_of = np.flatnonzero(np.concatenate(([True], hubs[1:] != hubs[:-1])))
        first = np.repeat(start_of, np.diff(np.append(start_of, len(hubs))))
        a, b = mine[first], mine
        near = (away[first] <= distance // 2) & (a != b)
        found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def near_links(nodes: DataFrame, distance: int, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column fp) within ``distance`` bits."""
    radius = (distance + 1) // 2

    def deal(batches):
        for batch in batches:
            whole = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(whole), 20_000):
                fps = whole[at:at + 20_000]
                cells = grid_cells(fps, radius, segments)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().view(np.int64)), pa.array(np.repeat(fps, cells.shape[1]).view(np.int64))], ["cell", "fp"])

    def verify(batches):
        # One partition holds whole cells, sorted; a cut falls between two cells.
        held = ([], [])

        def out(c, f):
            a, b = links_in_cells(c.view(np.uint64), f.view(np.uint64), distance)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            held[0].append(batch.column("cell").to_numpy())
            held[1].append(batch.column("fp").to_numpy())
            if sum(map(len, held[0])) >= 400_000 and held[0][-1][-1] != held[0][0][0]:
                c, f = np.concatenate(held[0]), np.concatenate(held[1])
                cut = int(np.searchsorted(c, c[-1]))
                yield out(c[:cut], f[:cut])
                held = ([c[cut:]], [f[cut:]])
        if held[0]:
            yield out(np.concatenate(held[0]), np.concatenate(held[1]))

    dealt = nodes.select("fp").mapInArrow(deal, "cell long, fp long")
    return (dealt.repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(verify, "a long, b long").distinct())


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int = SEGMENTS,
                   id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                   label_col: str | None = None) -> DataFrame:
    """Near-duplicate groups of all documents.

    Returns one row per input row: (row_col,) the id, ``fingerprint`` (16
    lowercase hex digits) and ``component_id``, the smallest id reachable over
    links of ``distance`` or fewer differing bits.  Words are split at ASCII
    white space and A-Z lower-cased; a text of fewer words than ``shingle`` is
    one shingle; NULL, empty and blank texts have fingerprint zero and link
    like any other.  Repeated rows share their fingerprint; a NULL id never
    names a component unless its component has no other id.  ``distance`` may
    be 0 to 4.  ``label_col`` adds the smallest fingerprint of the component
    (signed), its only name where ids repeat or are NULL.  Other columns are
    dropped.
    """
    if not 0 <= distance <= 4 or 64 % segments:
        raise ValueError("distance: 0 to 4; segments: a divisor of 64")
    fps = fingerprints(numbered(docs, id_col, text_col, row_col), shingle).checkpoint()
    nodes = fps.groupBy("fp").agg(F.min("id").alias("first")).checkpoint()
    labels = components(near_links(nodes, distance, segments).checkpoint())
    named = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    first = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(first, "label").select("fp", "component_id", "label")
    keep = [F.col("row").alias(row_col)] if row_col else []
    return fps.join(named, "fp").select(*keep, F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                                         *([F.col("label").alias(label_col)] if label_col else []))
