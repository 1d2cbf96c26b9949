"""Hand-made edge frames for the claims operators (payments, totals, spine,
nulls, duplicates, fills)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvid.operators import payments as pay
from corvid.operators import quality, recode, spine
from corvid.operators.ranking import rank_within

D = dt.date

PAY_SCHEMA = ("claim_number long, claimant_number long, data_source string, lob string, "
              "payment_date date, section string, clean_payment_status string, transaction_type string, "
              "payment_grouping1 string, payment_desc string, payment_amount double")


def test_latest_flag_over_all_rows_before_filter(spark):
    rows = [
        (1, 1, "s", "L", D(2020, 1, 1), "TPI", "Paid", "1", None, None, 10.0),
        (1, 1, "s", "L", D(2020, 2, 1), "OTHER", "Paid", "1", None, None, 20.0),  # latest, filtered out
        (1, 1, "s", "L", None, "TPI", "Paid", None, None, None, 30.0),             # NULL date -> 0
        (2, 1, "s", "L", D(2020, 3, 1), "TPI", "Paid", "2", None, None, 40.0),     # type 2 dropped
        (None, 1, "s", "L", D(2020, 3, 1), "TPI", "Paid", "1", None, None, 50.0),  # NULL key is a group
    ]
    df = spark.createDataFrame(rows, PAY_SCHEMA)
    out = {(r.claim_number, r.payment_amount): r["max"] for r in pay.paid_payments(df).collect()}
    assert out == {(1, 10.0): 0, (1, 30.0): 0, (None, 50.0): 1}


def test_latest_keep_latest(spark):
    rows = [(1, 1, "s", "L", D(2020, 1, 1), "TPI", "Paid", "1", None, None, 10.0),
            (1, 1, "s", "L", D(2020, 1, 5), "TPI", "Paid", "1", None, None, 11.0)]
    df = spark.createDataFrame(rows, PAY_SCHEMA)
    assert [r.payment_amount for r in pay.paid_payments(df, keep="latest").collect()] == [11.0]


def test_category_branch_order(spark):
    r = pay.CategoryRules()
    rows = [
        ("Our Solicitors", "Medical Reports", 216.0),
        ("General Damages", None, 1.0),
        (None, "Medical Reports", 216.0),
        (None, "Medical Report Fee", 780.0),
        (None, "Medical Reports", 216.01),
        (None, "Claimant Costs, Fees and Disbursements", 5.0),
        ("Special Damages", "NHS Ambulance", 5.0),
        ("Special Damages", None, 5.0),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "payment_grouping1 string, payment_desc string, payment_amount double")
    got = [x[0] for x in df.select(pay.category_expr(r)).collect()]
    assert got == [pay.OUR_LEGAL, pay.PSLA, pay.CLAIMANT_LEGAL, pay.CLAIMANT_LEGAL, pay.OTHER_COSTS,
                   pay.CLAIMANT_LEGAL, pay.OTHER_COSTS, pay.SPECIAL_DAMAGES, pay.OTHER_COSTS]


@pytest.mark.parametrize("total,flags", [
    (None, (0, 0, 0)), (100000.0, (0, 0, 0)), (100000.01, (1, 0, 1)), (299999.99, (1, 0, 1)),
    (300000.0, (1, 0, 0)), (300000.01, (1, 1, 0))])
def test_loss_flags(spark, total, flags):
    df = spark.createDataFrame([(total,)], "t double")
    r = pay.add_loss_flags(df, "t").first()
    assert (r.ft_large_loss1, r.ft_large_loss2, r.ft_large_loss3) == flags


def test_pivot_absent_category_is_null_and_sums_exact(spark):
    spine_df = spark.createDataFrame([(1, 1, "L", "s", D(2020, 1, 1), "O")],
                                     "claim_number long, claimant_number long, lob string, "
                                     "data_source string, claim_notification_date date, claim_status string")
    feat = spark.createDataFrame(
        [(1, 1, "L", "s", "TPI", "Paid", "1", pay.OUR_LEGAL, 0.1),
         (1, 1, "L", "s", "TPI", "Paid", "1", pay.OUR_LEGAL, 0.2),
         (9, 9, "L", "s", "TPI", "Paid", "1", pay.PSLA, 5.0)],   # no spine row: kept by right join
        "claim_number long, claimant_number long, lob string, data_source string, section string, "
        "clean_payment_status string, transaction_type string, ft_payment_desc_category string, "
        "payment_amount double")
    out = {r.claim_number: r for r in pay.pivot_payments(spine_df, feat).collect()}
    assert out[1][pay.OUR_LEGAL] == 0.3   # exact, not 0.30000000000000004
    assert out[1][pay.SPECIAL_DAMAGES] is None
    assert out[1][pay.TOTAL_SPEND] == 0.3
    assert out[9].claim_status is None and out[9][pay.TOTAL_SPEND] == 5.0


def test_attach_fans_out_and_dedupes_names(spark):
    s = spark.createDataFrame([(1, "s", "a"), (2, "s", "b")], "claim_number long, data_source string, x string")
    c = spark.createDataFrame([(1, "s", 10, "T"), (1, "s", 11, "T"), (1, "s", 11, "T"), (3, "s", 12, "T")],
                              "claim_number long, data_source string, claimant_number long, t string")
    out = spine.attach(s, c, ["claim_number", "data_source"], ["claimant_number", "t", "t"])
    assert out.columns.count("t") == 1
    assert sorted((r.claim_number, r.claimant_number) for r in out.collect()) == [(1, 10), (1, 11), (2, None)]
    f = quality.fanout_check(out, ["claim_number"]).first()
    assert (f.n_rows, f.n_keys, f.max_rows_per_key) == (3, 2, 2)


def test_one_row_per_key_is_deterministic_min(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, None, 5), (2, "z", 1)], "k long, s string, v long")
    got = sorted((r.k, r.s, r.v) for r in spine.one_row_per_key(df, ["k"]).collect())
    assert got == [(1, None, 5), (2, "z", 1)]   # NULLs first, then by the next column
    got2 = sorted((r.k, r.s, r.v) for r in spine.one_row_per_key(df, ["k"], order_by=["v"]).collect())
    assert got2 == [(1, "b", 2), (2, "z", 1)]


def test_duplicate_keys_null_semantics(spark):
    df = spark.createDataFrame([(None, "s"), (None, "s"), (1, None), (1, None), (2, "s")],
                               "claim_number long, data_source string")
    got = sorted(tuple(r) for r in quality.duplicate_keys(df).collect())
    assert got == [(1, None), (1, None)]   # NULL claim numbers are not counted (Q7)
    all_rows = quality.duplicate_keys(df, count_col=None).count()
    assert all_rows == 4


def test_drop_null_columns_rule(spark):
    n = 100
    rows = [(i, None if i < 98 else 1, None if i < 99 else 1, None, float("nan")) for i in range(n)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long, e double")
    assert quality.drop_null_columns(df, 0.99).columns == ["a", "b", "e"]   # >= 99 % NULL goes
    empty = df.limit(0)
    assert quality.drop_null_columns(empty, 0.99).columns == []             # Q12: all dropped
    assert quality.drop_null_columns(empty, 0.99, guard_empty=True).columns == df.columns


def test_fill_is_type_checked(spark):
    df = spark.createDataFrame([(None, None)], "s string, n double")
    assert recode.fill_nulls(df, "0", ["s"]).first().s == "0"
    with pytest.raises(TypeError):
        recode.fill_nulls(df, "0", ["n"])
    with pytest.raises(TypeError):
        recode.fill_nulls(df, 0, ["s"])


def test_indicator_recode_null_is_zero(spark):
    df = spark.createDataFrame([("true", "Yes"), ("false", "No"), (None, None)], "a string, b string")
    out = recode.recode_indicators(df, {"a": "true", "b": "Yes"}).collect()
    assert [(r.a, r.b) for r in out] == [(1, 1), (0, 0), (0, 0)]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5", "x"), (None, "2")], "a string, b string")
    out = recode.coerce_numeric(df, ["a", "b", "a"]).collect()
    assert [(r.a, r.b) for r in out] == [(1.5, 0.0), (0.0, 2.0)]


@pytest.mark.parametrize("per_bucket", [1_000_000, 7])
def test_rank_within_buckets_agree(spark, per_bucket):
    df = spark.range(0, 200).select((F.col("id") * 7919 % 1009).alias("o"), (F.col("id") % 3).alias("g"))
    out = rank_within(df, ["g"], ["o"], rows_per_bucket=per_bucket).collect()
    by_group = {}
    for r in out:
        by_group.setdefault(r.g, []).append((r.o, r._rank))
    for pairs in by_group.values():
        pairs.sort()
        assert [rk for _, rk in pairs] == list(range(len(pairs)))


@pytest.mark.parametrize("per_bucket", [1, 7, 1_000_000])
def test_rank_within_keeps_every_row(spark, per_bucket):
    """NULL order and group, NaN, -0.0 and tied leads: as the plain window, nothing lost."""
    from pyspark.sql import Window
    values = [None, float("nan"), -0.0, 0.0, 1.0, 1.0, float("inf"), float("-inf"), None]
    rows = [(i, ["a", None, "b"][i % 3], values[i % len(values)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, o double")
    for groups in (["g"], []):
        w = Window.partitionBy(*groups).orderBy("o", "id")
        want = {r.id: r.rk for r in df.withColumn("rk", F.row_number().over(w) - 1).collect()}
        got = rank_within(df, groups, ["o", "id"], rows_per_bucket=per_bucket).collect()
        assert len(got) == 60 and {r.id: r._rank for r in got} == want
    tied = rank_within(df, [], ["g"], rows_per_bucket=per_bucket).collect()
    assert sorted(r._rank for r in tied) == list(range(60))


def test_money_keeps_all_decimals(spark):
    from corvid.functions.columns import money_sum
    df = spark.createDataFrame([(0.004,)] * 1000 + [(None,)], "x double")
    assert df.agg(money_sum("x")).first()[0] == 4.0
    with pytest.raises(Exception, match="more than 2 decimals"):
        df.agg(money_sum("x", 2)).first()
