import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.llm.chat import LOG_SCHEMA, _role_in, _role_out, escaped, format_chats, log_of_turns, read_back, unescaped
from corvid.llm.q_structure import ODD, OP13_SQL, op13_chat_formatting


def by_sql(turns):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", turns)
    return sorted(con.sql(OP13_SQL).fetchall(), key=str)


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{d}/conversations.parquet'")
    got = op13_chat_formatting(spark, d)
    assert got.columns == con.sql(OP13_SQL).columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(con.sql(OP13_SQL).fetchall()) and rows[0][:2] == (-7, 2) and rows[0][3] == len(ODD)


@settings(deadline=None, max_examples=20)
@given(st.lists(st.text(alphabet="\\#</turn>ab: %3A25\n.", max_size=14), min_size=1, max_size=30))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u"), _role_out(F.col("t")).alias("ro"), _role_in(_role_out(F.col("t"))).alias("ri"))
    for r in df.collect():
        assert r["u"] == r["t"] == r["ri"] and "</turn>" not in r["e"] and "###" not in r["e"] and ":" not in r["ro"]


def test_odd_turns_in_one_part_and_in_many(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, None, "assistant", "first"), (2, 5, "assistant", "a" * 200_000),
             (None, 0, "user", "null id"), (None, 1, "assistant", "### user: </turn>\n####"), (3, 7, "a: b%3A\\", "::"), (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie a"),
             (4, 1, "user", "tie"), (-7, 3, "user", "beside the others"), *[(5, k, ("user", "assistant")[k % 2], f"{k} \\ ü 🙂" * (k % 3)) for k in range(700)]]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, formatted string, seq int")
    both = df.select("conv_id", "turn", "role", "text").unionAll(spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id long, turn long, role string, text string"))
    want = by_sql(turns)
    for events, messages in ((256, 64), (4, 1), (1, 3), (10**6, 64)):
        chats = format_chats(log_of_turns(both), events, messages)
        assert sorted(map(tuple, read_back(chats).collect()), key=str) == want
    assert chats.where("part IS NOT NULL").isEmpty()
    assert read_back(format_chats(log_of_turns(df.limit(0)))).collect() == []


@pytest.mark.parametrize("events", [1, 2, 100])
def test_fold(spark, events):
    log = [(1, 0, 0, None, "message", "user", "hel"), (1, 1, 0, None, "delta", None, "lo"), (1, 2, 1, None, "message", "assistant", None), (1, 3, 1, None, "delta", None, "wrong"),
           (1, 4, 1, None, "regenerate", None, None), (1, 5, 1, None, "delta", None, "ri"), (1, 6, 1, None, "delta", None, "ght"), (1, 7, 0, None, "edit", None, "bye"), (1, 8, 0, None, "delta", None, "!"),
           (1, 9, 2, None, "delta", None, "nobody"), (1, 10, 1, None, "unknown", None, "?"), (1, None, 1, None, "delta", None, "before all"),
           (1, 10**15, 9, None, "message", "system", "far"), (None, 1, None, None, "message", "assistant", "n")]
    df = spark.createDataFrame(log, LOG_SCHEMA)
    rows = format_chats(df, events, 1).orderBy("conv_id", "part").collect()
    got = {}
    for r in rows:
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["formatted"]
        for s in r["spans"]:
            assert r["formatted"][s["start"]:s["start"] + s["length"]] in ("right?", "n")
    assert got == {1: "### user: bye!</turn>\n### assistant: right?</turn>\n### : nobody</turn>\n### system: far</turn>\n", None: "### assistant: n</turn>\n"}
    assert format_chats(df.limit(0)).collect() == []
