"""Periodic run detection: Lyndon roots by grouping suffixes, extended to runs.

A run is a stretch of words that repeats with a smallest period and cannot be
lengthened.  Every run holds a Lyndon word of its period that is the longest
Lyndon word at its place, under an order of the words or its reverse.  The
first phase of the grouping suffix sorter ends with the suffixes grouped by
just these words, so its groups give the Lyndon array, once for each order; a
root is then lengthened to both sides by longest common extensions.

Only stretches in which a window of as many words as every wanted run repeats
at least can hold a wanted run, so the other words are never grouped.
"""

from __future__ import annotations

import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from corvid.llm.common import mix, numbered, per_chunk, rolling, runs, spans_of, word_hashes

#: A run has at least so many words, and at least so many periods.
MIN_WORDS = 24
MIN_PERIODS = 3

SCHEMA = ("row long, id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def lyndon_array(letters: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by the first phase of suffix grouping.

    Suffixes start in one group per first letter.  Groups are taken from the
    highest down; a group's suffixes point to the nearest place to their left
    that is in a lower group, and places pointed to equally often leave their
    group for a new one just above it, lengthened by that many of the taken
    group's words.  When all groups are taken, each group's word is the
    longest Lyndon word of its places.  Nearly linear.
    """
    # Places count from 1; place 0 is below all and is never taken.
    first: dict[int, list[int]] = {}
    for place, letter in enumerate(letters, 1):
        first.setdefault(letter, []).append(place)
    members = [[], *(first[letter] for letter in sorted(first))]
    width = [0] + [1] * len(first)
    below = list(range(-1, len(first)))
    above = [*range(1, len(first) + 1), -1]
    group_of = [0] * (len(letters) + 1)
    for group, places in enumerate(members):
        for place in places:
            group_of[place] = group
    # Nearest place not yet taken, at or to the left of each; followed and shortened like a union-find forest.
    left = list(range(len(letters) + 1))
    group = len(first)
    while group > 0:
        places = [p for p in members[group] if group_of[p] == group]
        for p in places:
            left[p] = p - 1
        times: dict[int, int] = {}
        for p in places:
            to = left[p]
            while left[to] != to:
                left[to] = left[left[to]]
                to = left[to]
            left[p] = to
            if to:
                times[to] = times.get(to, 0) + 1
        made: dict[tuple[int, int], int] = {}
        order = times.items()
        if len(times) > 1 and max(times.values()) > 1:
            order = sorted(order, key=lambda x: -x[1])
        for p, n in order:
            host = group_of[p]
            new = made.get((host, n))
            if new is None:
                new = made[host, n] = len(members)
                members.append([])
                width.append(width[host] + n * width[group])
                up = above[host]
                above[host], below[up] = new, new
                below.append(host)
                above.append(up)
            members[new].append(p)
            group_of[p] = new
        group = below[group]
    return [width[g] for g in group_of[1:]]


def _stretches(units: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches covered by windows that occur more than once in their text."""
    n = len(units)
    text = np.repeat(np.arange(len(sizes)), sizes)
    hashes = rolling(units, window, 7)
    at = np.flatnonzero(text[:len(hashes)] == text[window - 1:]) if len(hashes) else np.zeros(0, np.int64)
    keys = hashes[at] ^ mix(text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    start = runs(keys[order])
    size = np.diff(np.append(start, len(keys)))
    repeated = at[order[np.repeat(size > 1, size)]]
    step = np.bincount(repeated, minlength=n + 1) - np.bincount(repeated + window, minlength=n + 1)
    starts, ends = spans_of(np.cumsum(step)[:n] > 0)
    if not len(starts):
        return starts, ends
    # Stretches of neighbouring texts can touch.
    edges = np.cumsum(sizes)[:-1]
    inside = edges[np.searchsorted(starts, edges, "right") > np.searchsorted(ends, edges, "right")]
    return np.sort(np.concatenate((starts, inside))), np.sort(np.concatenate((ends, inside)))


def _extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many letters from places ``a`` and ``b`` on (or before them, going back) are equal."""
    n, same = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        x, y = (a - same - step, b - same - step) if back else (a + same, b + same)
        ok = (x >= 0) if back else (y + step <= n)
        at = np.flatnonzero(ok)
        hit = at[levels[k][x[at]] == levels[k][y[at]]]
        same[hit] += step
    return same


def find_runs(stretches: list[list], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of three periods or more of each list of words, by start and period.

    Common extensions are read off hashes of 1, 2, 4 ... letters for all
    roots of all lists at once; every run found is compared letter by letter.
    """
    numbers: dict = {}
    codes = [[numbers.setdefault(w, len(numbers)) for w in words] for words in stretches]
    # Laid end to end, with a letter of its own after each.
    flat: list[int] = []
    offsets, roots = [], []
    for own, letters in enumerate(codes):
        offsets.append(len(flat))
        for signed in (letters, [-x for x in letters]):
            roots.append((np.arange(len(letters)) + len(flat), np.array(lyndon_array(signed), np.int64)))
        flat += letters
        flat.append(-1 - own)
    found: list[list] = [[] for _ in codes]
    if not flat:
        return found
    letters = np.array(flat, np.int64)
    a = np.concatenate([r[0] for r in roots])
    q = np.concatenate([r[1] for r in roots])
    # A run of three periods or more has a root that is followed by another: its first and last letters come again.
    far = a + 2 * q <= len(letters)
    a, q = a[far], q[far]
    again = (letters[a] == letters[a + q]) & (letters[a + q - 1] == letters[a + 2 * q - 1])
    a, q = a[again], q[again]
    levels = [mix(letters.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))]
    longest = max(len(c) for c in codes)
    while 1 << len(levels) <= longest:
        half, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(mix(half[:-step] * np.uint64(0xD6E8FEB86659FD93) + half[step:]) if len(half) > step else half[:0])
    start = a - _extend(levels, a, a + q, True)
    length = a + q + _extend(levels, a, a + q, False) - start
    long = length >= np.maximum(min_words, min_periods * q)
    for s, n, p in np.unique(np.stack((start[long], length[long], q[long]), 1), axis=0).tolist():
        if not np.array_equal(letters[s:s + n - p], letters[s + p:s + n]):
            raise ArithmeticError("two hashes of different words are equal")
        own = int(np.searchsorted(offsets, s, "right")) - 1
        found[own].append((s - offsets[own], n, p))
    return found


def looped(id_: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text whose tail is made periodic; None where it is left alone."""
    h = zlib.crc32(b"" if id_ is None else str(id_).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _digests(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """The columns of one text."""
    keep = np.ones(len(words), bool)
    for s, n, p in found:
        keep[s + p:s + n] = False
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    of = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    kept = words if not found else [words[i] for i in np.flatnonzero(keep).tolist()]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (len(found), *of, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                  min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, loop: bool = False) -> DataFrame:
    """Runs of words in each text, and the text with every run cut to its first period.

    Returns one row per input row: (row_col,) the id, n_runs, the run with the
    greatest length / period (start, length, period, exponent_milli; ties: the
    smallest start, then period; NULL without a run), runs_sha256 (all runs as
    ``start,length,period`` lines) and collapsed_sha256 (the words kept,
    joined by one space).  Words are runs of characters other than ASCII
    white space, numbered from 0; a run has at least ``min_words`` words and
    ``min_periods`` periods (three at least).  ``loop`` first makes the tail of
    a tenth of the texts, drawn by their id, periodic (see ``looped``).

    NULL text is empty; empty texts have no run; a NULL id counts as the
    empty text where ids are drawn; repeated rows keep a row each; other
    columns are dropped.  A text is worked on whole in one task, a very long
    one as a chunk of its own; no row is shuffled.
    """
    if min_periods < 3 or min_words < 2 * min_periods:
        raise ValueError("a run has three periods and twice as many words as periods at least")
    # For any period, a wanted run has so many words beside one period.
    window = min(max(min_words, min_periods * q) - q for q in range(1, min_words + 1))

    def work(chunk, rows, ids, texts):
        units, sizes = word_hashes(texts)
        ends = np.cumsum(sizes)
        order: dict[int, np.ndarray] = {}
        if loop:
            for k, (i, n) in enumerate(zip(ids, sizes.tolist())):
                at = looped(i, n)
                if at is not None:
                    order[k] = at
                    units[ends[k] - n:ends[k]] = units[ends[k] - n:ends[k]][at]
        starts, stops = _stretches(units, sizes, window)
        owner = np.searchsorted(ends, starts, "right").tolist()
        words: dict[int, list[bytes]] = {}

        def words_of(k):
            split = texts[k].split()
            return [split[i] for i in order[k].tolist()] if k in order else split
        for k in set(owner):
            words[k] = words_of(k)
        places = [(k, s - int(ends[k] - sizes[k]), e - s) for k, s, e in zip(owner, starts.tolist(), stops.tolist())]
        got: dict[int, list] = {}
        for (k, s, _), found in zip(places, find_runs([words[k][s:s + n] for k, s, n in places], min_words, min_periods)):
            got.setdefault(k, []).extend((s + at, n, p) for at, n, p in found)
        for k, (row, i) in enumerate(zip(rows, ids)):
            yield row, i, *_digests(words.pop(k, None) or words_of(k), sorted(got.get(k, []), key=lambda r: (r[0], r[2])))

    out = per_chunk(numbered(docs, id_col, text_col, row_col), work, SCHEMA)
    return out.withColumnsRenamed({"id": id_col} | ({"row": row_col} if row_col else {})).drop(*([] if row_col else ["row"]))
