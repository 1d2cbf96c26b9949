import pytest

import corpus_pipeline as cp
from corvid.llm import decontaminate, naming, pii, urls

SPLIT = "spark.sql.files.maxPartitionBytes"
TEXTS = [f"{'abcdefghij'[k % 10] * 40} write to u{k % 10}@x.org or +1 555 123 45{k % 10:02} " + "one two three four five six seven eight nine ten " * (k % 3) for k in range(40)]


@pytest.fixture
def table(spark, tmp_path):
    """A table of four files, read with other splits once ``swap`` is called."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartitionByRange(4, "doc_id").write.parquet(path)
    spark.conf.set(SPLIT, "1m")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark.read.parquet(path)
    spark.conf.unset(SPLIT)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def swapping(spark, monkeypatch, module, name):
    """Other splits from the first call of a step on, as after a lost executor."""
    step = getattr(module, name)

    def run(*args, **kwargs):
        spark.conf.set(SPLIT, "600b")
        return step(*args, **kwargs)
    monkeypatch.setattr(module, name, run)


def same(spark, table, monkeypatch, module, name, use):
    want = sorted(map(tuple, use(table).collect()), key=str)
    swapping(spark, monkeypatch, module, name)
    spark.conf.set(SPLIT, "1m")
    assert want and sorted(map(tuple, use(table).collect()), key=str) == want


def test_exact_groups_after_other_splits(spark, table, monkeypatch):
    same(spark, table, monkeypatch, naming, "identities", naming.exact_groups)


def test_pii_after_other_splits(spark, table, monkeypatch):
    same(spark, table, monkeypatch, pii, "featured", pii.find_pii)


def test_contaminated_after_other_splits(spark, table, monkeypatch):
    items = spark.createDataFrame([(1, TEXTS[2]), (2, TEXTS[5])], "item_id long, text string")
    same(spark, table, monkeypatch, decontaminate, "blocks_of", lambda t: decontaminate.contaminated(t, items))


def test_urls_after_other_splits(spark, table, monkeypatch):
    import datetime as dt
    entries = spark.createDataFrame([("l", f"h{k}.org", dt.date(2020, 1, 1), True) for k in range(0, 9, 2)], "list string, key string, day date, listed boolean")
    captures = table.selectExpr("doc_id AS page_id", "concat('http://h', doc_id % 9, '.org/', doc_id) AS url", "DATE '2021-01-01' AS fetched")
    same(spark, captures, monkeypatch, urls, "intervals", lambda t: urls.evaluate(t, entries))


def test_row_keys_are_unique_over_files_and_frames(spark, table):
    from corvid.llm.common import row_keys
    for frame in (table, table.where("doc_id > 3").select("doc_id"), table.unionAll(table), table.join(table.withColumnRenamed("text", "t"), "doc_id")):
        keyed = row_keys(frame, "k").checkpoint()
        assert keyed.columns == [*frame.columns, "k"] and keyed.count() == frame.count() == keyed.select("k").distinct().count()


@pytest.mark.parametrize("stage, step", [(cp.exact_stage, "exact_groups"), (cp.near_stage, "simhash_groups"), (cp.decontamination_stage, "contaminated")])
def test_stages_after_other_splits(spark, table, monkeypatch, tmp_path, stage, step):
    spark.createDataFrame([(1, TEXTS[2]), (2, TEXTS[5])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    operator = getattr(cp, step)

    def run(docs, *args, **kwargs):
        rows = operator(docs, *args, **kwargs).checkpoint()
        spark.conf.set(SPLIT, "600b")
        return rows
    want = sorted(map(tuple, stage(spark, table, str(tmp_path)).collect()))
    monkeypatch.setattr(cp, step, run)
    assert want and sorted(map(tuple, stage(spark, table, str(tmp_path)).collect())) == want


def test_splits_are_pinned(spark, table):
    """Operators that read their chunks more than once get the same ones when the number of cores changes between two reads."""
    from corvid.llm.common import numbered
    name = "spark.sql.files.minPartitionNum"
    spark.conf.unset(name)
    spark.conf.unset(SPLIT)
    rows = numbered(table)
    assert spark.conf.get(name) == str(spark.sparkContext.defaultParallelism)
    first = rows.select("row", "id").collect()
    assert numbered(table).select("row", "id").collect() == first
    spark.conf.set(name, "1")
    numbered(table)
    assert spark.conf.get(name) == "1"   # a caller's setting stays
    spark.conf.unset(name)
