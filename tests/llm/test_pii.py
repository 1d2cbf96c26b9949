import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corvid.llm import pii
from corvid.llm.pii import find_pii, first_of_overlaps
from corvid.llm.q_filters import op3_pii_boosting

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checked(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    kinds = list(PATTERNS)
    found = sorted((m.start(), kinds.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if checked(k, m[0]))
    listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in found]
    return (*[sum(k == j for _, k, _ in found) for j in range(4)], hashlib.sha256(",".join(listed).encode()).hexdigest()), listed


def same(rows, texts):
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in texts), key=str)
    want = sorted(((i, *brute(t)[0]) for i, t in texts), key=str)
    assert sorted((tuple(r)[:6] for r in rows), key=str) == want
    by_id = {i: brute(t)[1] for i, t in texts}
    for r in rows:
        spans = r["spans"].split(",") if r["spans"] else []
        if r["doc_id"] is not None:
            assert set(by_id[r["doc_id"]]) <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = op3_pii_boosting(spark, d).collect()
    same(rows, texts)
    by_id = {i: len(brute(t)[1]) for i, t in texts}
    clean = sum(not n for n in by_id.values())
    assert sum(bool(r["spans"]) and not by_id[r["doc_id"]] for r in rows) <= 0.02 * clean


ODD = ["é 🙂 a.b+c@x-y.co.uk, a@b b@c.d x@y.z@w.v.u ..@a.b a@b..c %@1.2.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.02.3.255 999999999999999999999.1.1.1 1..2.3.4",
       "4111 1111 1111 1111 and 4111-1111-1111-1111 4111 1111 1111 1112 4111  1111 1111 1111 5500000000000004-", "+1 (555) 123-4567 +1 2 +12 + 1 +441234567890123456 +1.2.3.4.5.6.7.8.9.0 +1(())--2 x+49 30 1234567)",
       "a@b.c_d@e.f.g-h@i.j", "+1 4111 1111 1111 1111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "", None, "9" * 30000, "a" * 30000 + "@" + "b.c" * 1000, "+" + "1 " * 5000, "1." * 20000, "x@" * 5000,
       "\n1.2.3.4\n5.6.7.8", "tel +1 (555) 123-4567.", "٣٤٥ 1٣.2.3.4"]


def test_odd_rows(spark):
    texts = [(k, t) for k, t in enumerate(ODD)] + [(None, "a@b.cd"), (None, "a@b.cd")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, start int, kind int")
    same(find_pii(df).collect(), texts)
    assert find_pii(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_random_signs(spark, seed):
    rng = random.Random(seed)
    texts = [(k, "".join(rng.choice("aé@..+-()  1234567890%") for _ in range(rng.randint(0, 120)))) for k in range(300)]
    same(find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)


def test_near_forms_are_added(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [(k, f"call +1 (555) {digits(3)}-{digits(4)} today, part 20{digits(2)}-0{k % 9 + 1}-1{k % 10}x") for k in range(1500)]
    near = "call (555) 123-4567 today"
    rows = find_pii(spark.createDataFrame(texts + [(9000, near), (9001, "call 1 (555) 765 4321 today")], "doc_id long, text string")).collect()
    added = {r["doc_id"]: r["spans"] for r in rows if r["doc_id"] >= 9000}
    assert added == {9000: "phone:6:19", 9001: "phone:5:21"}
    assert all(r["spans"].count(":") == 2 for r in rows if r["doc_id"] < 9000)


def test_a_dropped_span_hides_no_other(spark):
    spans = spark.createDataFrame([(1, "at", "email", 0, 10), (1, "digits", "phone", 5, 15), (1, "digits", "phone", 12, 20), (1, "at", "email", 20, 25), (2, "at", "email", 3, 9)],
                                  "row long, gen string, kind string, start long, end long")
    assert sorted(map(tuple, first_of_overlaps(spans).collect())) == [(1, "email", 0, 10), (1, "email", 20, 25), (1, "phone", 12, 20), (2, "email", 3, 9)]


def test_near_forms_that_are_no_longer_rare(spark):
    """A hundredth of the rows holds a near form of each kind, as many as checked ones; other numbers and signs are left alone."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n=16):
        body = digits(n - 1)
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    four = lambda c, sep: sep.join(c[k:k + 4] for k in range(0, 16, 4))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    checked = [lambda: f"call +1 (555) {digits(3)}-{digits(4)} today", lambda: f"card {four(card(), ' ')} valid", lambda: f"mail {word()}@{word()}.org now"]
    near = [lambda: f"call (555) {digits(3)}-{digits(4)} today", lambda: f"card {four(card(), '/')} valid", lambda: f"mail {word()}@{word()} now"]
    other = [lambda: f"built 20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} as no {digits(7)}", lambda: f"order {digits(3)}/{digits(4)} weighs {digits(2)}.{digits(3)}", lambda: f"see {word()}@2x and @{word()}", word]
    texts, planted = [], {}
    for k in range(9000):
        kind = k % 100
        if kind < 3:
            texts.append((k, near[kind]()))
            planted[k] = ("phone", "card", "email")[kind]
        else:
            texts.append((k, (checked[kind - 3] if kind < 6 else other[k % 4])()))
    got = {r["doc_id"]: r["spans"] for r in find_pii(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    for kind in ("phone", "card", "email"):
        mine = [k for k, v in planted.items() if v == kind]
        assert sum(got[k].startswith(kind) for k in mine) >= 0.9 * len(mine), kind
    wrong = [k for k, t in texts if k not in planted and k % 100 >= 6 and got[k]]
    assert len(wrong) <= 0.01 * len(texts)
    assert all(got[k].count(":") == 2 for k, _ in texts if 3 <= k % 100 < 6)


def test_every_form_takes_part_in_the_fit(spark, monkeypatch):
    """More distinct forms than MLlib samples from, or any bound: all are given to the first fit or calibrate."""
    texts = spark.range(12_000).selectExpr("id AS doc_id", "concat('call +1 (555) ', 100 + id div 7000, '-', lpad(id, 5, '0'), ' today, part 20', lpad(id, 5, '0'), '-0', id % 9 + 1, '-1x') AS text")
    given, real = [], pii._boosted
    monkeypatch.setattr(pii, "_boosted", lambda part, trees: given.append({r["y"]: (r["n"], r["w"]) for r in part.groupBy("y").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}) or real(part, trees))
    halves = []
    scored = pii._scored
    monkeypatch.setattr(pii, "_scored", lambda spans, model: halves.append(spans.count()) or scored(spans, model))
    assert find_pii(texts, trees=2).count() == 12_000
    assert halves[0] == 24_000 and all(5_500 < n < 6_500 and w == n for n, w in given[0].values())


def test_cuts_come_from_all_rows():
    for n in (1, 10_000, 10_001, 1_000_000, 123_456_789):
        assert max(pii._bins(n) ** 2, 10_000) >= n and pii._bins(n) >= 32
