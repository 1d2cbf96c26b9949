"""Edge frames and property tests for notes, words and lexicon operators."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from corvid.operators import lexicon as lx
from corvid.operators import notes as nt
from corvid.operators import words as wd


def test_parse_note_time_bad_rows_are_null(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05",), ("2020-01-02",), ("garbage",), (None,)],
                               "transaction_date string")
    out = [(r.notes_date, r.notes_date_time) for r in nt.parse_note_time(df).collect()]
    assert out[0] == (dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5))
    assert out[1:] == [(None, None)] * 3


def test_parse_note_time_timestamp_input(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 5, 6, 7, 8, 9),)], "transaction_date timestamp_ntz")
    r = nt.parse_note_time(df).first()
    assert r.notes_date == dt.date(2021, 5, 6)


def test_notes_same_day_filter_order_and_lower(spark):
    master = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "claim_number long, claim_notification_date date")
    t = dt.datetime
    notes = spark.createDataFrame([
        (1, dt.date(2020, 1, 1), t(2020, 1, 1, 9), "Second B"),
        (1, dt.date(2020, 1, 1), t(2020, 1, 1, 8), "First A"),
        (1, dt.date(2020, 1, 1), t(2020, 1, 1, 9), "Second A"),     # same time: text breaks the tie
        (1, dt.date(2020, 1, 1), t(2020, 1, 1, 7), "Blackboard x"),  # boilerplate
        (1, dt.date(2020, 1, 1), t(2020, 1, 1, 7), "blackboard kept"),  # case-sensitive
        (1, dt.date(2020, 1, 1), t(2020, 1, 1, 7), None),            # NULL text dropped
        (1, dt.date(2020, 1, 2), t(2020, 1, 2, 7), "Other day"),
    ], "claim_number long, notes_date date, notes_date_time timestamp_ntz, fnol_notes string")
    r = nt.notes_same_day(master, notes).first()
    assert r.number_of_notes == 4
    assert r.fnol_notes == "blackboard kept~first a~second a~second b"
    allr = nt.notes_all(master, notes).first()
    assert allr.number_of_notes_all == 5 and allr.all_notes.endswith("~other day")


def test_clean_text_rules(spark):
    df = spark.createDataFrame([("  Hello,  World!! v1.2 ",), (None,)], "t string")
    out = [r.t for r in nt.clean_text(df, "t").collect()]
    assert out == [" hello world v1.2 ", "no note"]   # no trim


def test_concat_of_a_hot_claim_by_ranges(spark):
    """A claim with a third of all notes is joined by ranges; the result is that of the simple plan."""
    rng = random.Random(8)
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 and k < 400 else k % 50, rng.choice([None, *range(40)]), rng.choice(["x", "yy", None, "", f"n{k}"])) for k in range(900)]
    df = spark.createDataFrame(rows, "claim int, at int, note string").repartition(5)
    simple = sorted(map(tuple, nt.ordered_concat(df, ["claim"], ["at"], "note").collect()), key=str)
    for per in (10, 40):
        assert sorted(map(tuple, nt.ordered_concat(df, ["claim"], ["at"], "note", rows_per_task=per).collect()), key=str) == simple
    hot = nt.ordered_ranges(df.where("claim = 7"), ["claim"], ["at", "note"], 8).groupBy("claim", "_range").count().collect()
    assert len(hot) >= 6 and max(r["count"] for r in hot) <= 3 * 300 / 8
    by_claim = {}
    for c, a, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is None, r[2] or "")):
        by_claim.setdefault(c, []).append(t)
    assert {c: t for c, _, t in simple} == {c: "~".join(t for t in ts if t is not None) for c, ts in by_claim.items()}
    assert {c: n for c, n, _ in simple} == {c: len(ts) if c is not None else 0 for c, ts in by_claim.items()}


def test_word_count_split_and_stop_words(spark):
    df = spark.createDataFrame([(" The cat\tthe\nCAT dog ",), (None,)], "t string")
    plain = {r.word: r["count"] for r in wd.word_count(df, "t").collect()}
    assert plain == {"The": 1, "cat": 1, "the": 1, "CAT": 1, "dog": 1}
    stop = {r.word: r["count"] for r in wd.word_count(df, "t", wd.stop_words()).collect()}
    assert stop == {"cat": 1, "CAT": 1, "dog": 1}
    sw = wd.stop_words()
    assert "no" in sw and "policy" in sw and len(sw) == len(set(sw))


TOK = (lx.TokenKey("injury", ("injury", "injured"), ("no",)),
       lx.TokenKey("child", ("child", "kids")),
       lx.TokenKey("pre", ("pre",), ("x",), offset=1))


@pytest.mark.parametrize("text,expected", [
    ("injury at first", {"injury": 1, "child": 0, "pre": 0}),
    ("there was no injury", {"injury": -1, "child": 0, "pre": 0}),
    ("no injury but injured", {"injury": 1, "child": 0, "pre": 0}),
    ("no injured. kids", {"injury": -1, "child": 1, "pre": 0}),
    ("nothing here", {"injury": 0, "child": 0, "pre": 0}),
    ("no. injury", {"injury": 1, "child": 0, "pre": 0}),   # the full stop is a token
    ("pre x", {"injury": 0, "child": 0, "pre": -1}),       # look-ahead offset
    ("", {"injury": 0, "child": 0, "pre": 0}),
])
def test_token_signals(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    r = lx.token_signals(df, "t", TOK).first().asDict()
    assert r == expected


def _restate_tokens(text, lexicon):
    toks = __import__("re").findall(lx.TOKEN_PATTERN, text)
    syn = lx.synonym_map(lexicon)
    norm = [syn.get(t, t) for t in toks]
    out = {}
    for e in lexicon:
        vals = []
        for i, t in enumerate(norm):
            if t == e.key:
                j = i + e.offset
                vals.append(-1 if 0 <= j < len(norm) and norm[j] in e.negations else 1)
        out[e.key] = max(vals) if vals else 0
    return out


def test_token_signals_property(spark):
    rng = random.Random(7)
    vocab = ["no", "injury", "injured", "kids", "child", "the", ".", "pre", "x", "a1.b2"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: {k: r[k] for k in ("injury", "child", "pre")}
           for r in lx.token_signals(df, "t", TOK, keep=["i"]).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _restate_tokens(t, TOK), t


PH = lx.PhraseKey("k", ("ab", "cd"), ("xab", "abz", "qq"))


@pytest.mark.parametrize("text,expected", [
    ("ab", 1), ("xab", 0), ("abz", 0), ("qqab", 0),   # exclude ending exactly at the start
    ("qq ab", 1), ("xab ab", 1), ("them cd", 1), ("", 0), ("a b", 0),
])
def test_phrase_edges(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert lx.phrase_flags(df, "t", (PH,)).first().k == expected
    assert lx.scan_flag(text, PH) == expected


def test_phrase_regex_property(spark):
    rng = random.Random(11)
    keys = (PH, lx.PhraseKey("m", ("low", "speed"), ("low speed", "slow", "speeding")),
            lx.PhraseKey("n", ("tion",), ("ation", "tions", "en")))
    alphabet = "abcdxzq lowspeedtinon"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r for r in lx.phrase_flags(df, "t", keys, keep=["i"]).collect()}
    for i, t in enumerate(texts):
        for e in keys:
            assert got[i][e.key] == lx.scan_flag(t, e), (t, e.key)


def test_self_overlapping_phrase_uses_exact_scan(spark):
    e = lx.PhraseKey("o", ("aa",), ("baa",))
    assert lx.needs_scan(e)
    texts = ["aaa", "baaa", "baa aa", "baaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.o for r in lx.phrase_flags(df, "t", (e,)).collect()]
    assert got == [lx.scan_flag(t, e) for t in texts]


def test_trie_finds_what_single_searches_find(spark):
    rng = random.Random(3)
    phrases = ["a", "ab", "abc", "b", "bca", "ca.", "c+", "a b", "aab", "(c", "ü", "🙂", "\\d"]
    texts = ["".join(rng.choice(["a", "b", "c", ".", "+", " ", "(", "ü", "🙂", "\\", "d", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for r in df.select("i", "t", lx.phrases_found(F.col("t"), phrases).alias("f")).collect():
        longest = {max((p for p in phrases if r.t.startswith(p, k)), key=len, default=None) for k in range(len(r.t))} - {None} if r.t is not None else None
        assert (set(r.f) if r.f is not None else None) == longest, r.t
    keys = [lx.PhraseKey(f"k{j}", tuple(rng.sample(phrases, 3)), tuple(rng.sample(phrases, j % 3))) for j in range(12)]
    for r in lx.phrase_flags(df, "t", keys, keep=["i"]).collect():
        for e in keys:
            assert r[e.key] == lx.scan_flag(texts[r.i] if r.i < len(texts) else None, e), (texts[r.i], e)


def test_domain_lexicon_on_built_texts(spark):
    rng = random.Random(4)
    words = [p for e in lx.PHRASE_LEXICON for p in (*e.include, *e.exclude)]
    texts = ["".join(rng.choice(words)[rng.randint(0, 3):] + rng.choice(["", " ", "s", " x "]) for _ in range(rng.randint(0, 8))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in lx.phrase_flags(df, "t", keep=["i"]).collect():
        assert [r[e.key] for e in lx.PHRASE_LEXICON] == [lx.scan_flag(texts[r.i], e) for e in lx.PHRASE_LEXICON], texts[r.i]
    assert lx.phrase_flags(df, "t", [lx.PhraseKey("none", ())], keep=["i"]).agg({"none": "max"}).first()[0] == 0
    with pytest.raises(ValueError):
        lx.phrase_flags(df, "t", [lx.PhraseKey("empty", ("",))])


def test_lint_finds_unreachable_entries():
    issues = lx.lint()
    entries = {w for _, w, _ in issues}
    assert "pedestrians/cyclists" in entries
    assert "intra-articular fracture" in entries
    assert "Low expectation about return to work" in entries
    assert "lacerations" in entries   # listed twice in the exclude list


def test_clean_text_property(spark):
    import re as _re
    rng = random.Random(5)
    alphabet = ["a", "B", "z", "0", "9", ".", " ", "  ", "\n", "\t", "é", "ß", "!", ",", "İ", "😀", "K"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["", " ", "!!!", "a", ".", " a ", "a\n", "\na"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.c for r in df.select("i", nt.clean_text_expr("t").alias("c")).collect()}
    for i, t in enumerate(texts):
        want = _re.sub(" +", " ", _re.sub("[^a-zA-Z0-9.]", " ", t)).lower()
        assert got[i] == want, repr(t)


def test_word_boundary_option(spark):
    texts = ["them and hem", "hem", "the hem.", "a thousand", "usa today", "inside usa", None, "red  car", "red-car", "redcar", "big red car"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    keys = [lx.PhraseKey("hem", ("hem",)), lx.PhraseKey("usa", ("usa",), ("inside usa",)), lx.PhraseKey("car", ("red car",), ("big red",))]
    got = {r.i: (r.car, r.hem, r.usa) for r in lx.phrase_flags(df, "t", keys, keep=["i"], word_boundary=True).collect()}
    want = [(0, 1, 0), (0, 1, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert [got[i] for i in range(len(texts))] == want


def test_sum_of_signals(spark):
    df = spark.createDataFrame([(0, "fire no fire fire"), (1, "no fire"), (2, ""), (3, None)], "i int, t string")
    keys = [lx.TokenKey("fire", ("fire",), ("no",)), lx.TokenKey("plain", ("fires",))]
    got = {r.i: r.fire for r in lx.token_signals(df, "t", keys, keep=["i"], reduce="sum").collect()}
    assert got == {0: 1, 1: -1, 2: 0, 3: 0}
    got = {r.i: r.fire for r in lx.token_signals(df, "t", keys, keep=["i"]).collect()}
    assert got == {0: 1, 1: -1, 2: 0, 3: 0}
