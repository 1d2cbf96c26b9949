import datetime as dt

import duckdb

from corvid.llm.q_filters import OP7_SQL, op7_temporal_url_filter
from corvid.llm.urls import evaluate, intervals

DAY = dt.date


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{d}/pages.parquet'")
    want = con.sql(OP7_SQL)
    got = op7_temporal_url_filter(spark, d)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str) and {r[4] for r in rows} == {True, False}


def test_as_of_and_odd_rows(spark):
    entries = [("l", "bad.com", DAY(2020, 1, 5), True), ("l", "bad.com", DAY(2020, 1, 9), False), ("l", "bad.com", DAY(2022, 3, 1), True),
               ("l", "bad.com", DAY(2022, 3, 1), True), ("m", "x.bad.com", DAY(2020, 1, 1), True), ("m", "ok.org/ads", DAY(2020, 1, 1), True),
               ("l", "tie.com", DAY(2020, 1, 1), True), ("l", "tie.com", DAY(2020, 1, 1), False), (None, "bad.com", DAY(2020, 1, 1), True), ("l", None, DAY(2020, 1, 1), True)]
    e = spark.createDataFrame(entries, "list string, key string, day date, listed boolean")
    caps = [(1, "http://bad.com/a", DAY(2020, 1, 4)), (2, "http://bad.com/a", DAY(2020, 1, 5)), (3, "https://u@X.bad.com:8080", DAY(2020, 1, 8)), (4, "http://bad.com", DAY(2020, 1, 9)),
            (5, "http://notbad.com", DAY(2020, 1, 6)), (6, "http://ok.org/ads?x", DAY(2021, 1, 1)), (6, "http://ok.org/ads?x", DAY(2021, 1, 1)), (7, "http://ok.org/other", DAY(2021, 1, 1)),
            (8, None, DAY(2021, 1, 1)), (9, "", DAY(2021, 1, 1)), (None, "http://bad.com", None), (10, "http://tie.com", DAY(2021, 1, 1)), (11, "http://bad.com/" + "p" * 50000, DAY(2023, 1, 1)), (12, "nonsense", DAY(2021, 1, 1))]
    df = spark.createDataFrame([(*c, "x") for c in caps], "page_id long, url string, fetched date, key string")
    got = sorted(((r["page_id"], r["lists"], r["n_rules"]) for r in evaluate(df, e).collect()), key=str)
    want = {1: ("", 0), 2: ("l", 1), 3: ("l,m", 2), 4: ("", 0), 5: ("", 0), 6: ("m", 1), 7: ("", 0), 8: ("", 0), 9: ("", 0), 10: ("", 0), 11: ("l", 1), 12: ("", 0), None: ("", 0)}
    assert got == sorted(((i, *want[i]) for i, _, _ in caps), key=str)
    assert evaluate(df.limit(0), e).collect() == []
    assert not any(r["blocked"] for r in evaluate(df, e.limit(0)).collect())


def test_repeated_listing_opens_no_interval(spark):
    e = spark.createDataFrame([("l", "a.com", DAY(2020, 1, 1), True), ("l", "a.com", DAY(2020, 1, 5), True), ("l", "a.com", DAY(2020, 1, 9), False), ("l", "a.com", DAY(2021, 1, 1), False),
                               ("l", "b.com", DAY(2019, 12, 1), True), ("l", "b.com", DAY(2020, 2, 1), True), ("l", "b.com", DAY(2022, 2, 1), True), ("l", "b.com", DAY(2022, 3, 1), False), ("l", "b.com", DAY(2022, 4, 1), True)],
                              "list string, key string, day date, listed boolean")
    assert sorted(map(tuple, intervals(e).collect()), key=str) == [
        ("l", "a.com", DAY(2020, 1, 1), DAY(2020, 1, 9)), ("l", "b.com", DAY(2019, 12, 1), DAY(2022, 3, 1)), ("l", "b.com", DAY(2022, 4, 1), None)]
    caps = spark.createDataFrame([(1, "http://a.com", DAY(2020, 1, 6)), (2, "http://b.com", DAY(2022, 2, 5))], "page_id long, url string, fetched date")
    assert sorted((r["page_id"], r["n_rules"], r["since"]) for r in evaluate(caps, e).collect()) == [(1, 1, DAY(2020, 1, 1)), (2, 1, DAY(2019, 12, 1))]
