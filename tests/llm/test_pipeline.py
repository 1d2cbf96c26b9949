import re

import corpus_pipeline as cp
from corvid.llm import toxicity

from test_decontaminate import brute as leaks
from test_packing import check_packing
from test_simhash import brute_groups

D = "/root/testdata/sf0.001"


def expected(spark, docs, sf_dir):
    """(doc_id, text) kept before packing, stage by stage in plain Python; only the tagger's scores are taken as given."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores, _ = model.score([t or "" for _, t in rows], {})
    rows = [r for r, s in zip(rows, scores) if s < 0.3]
    best = {}
    for k, (i, t) in enumerate(rows):
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, 0, 0, 0)), (-len(t or ""), i is None, i or 0, k))
    rows = [rows[b[3]] for b in best.values()]
    stay = {c for _, _, c in brute_groups(rows)}
    rows = [r for r in rows if r[0] in stay]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {i for i, _ in leaks(rows, items)}
    return [r for r in rows if r[0] not in gone]


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    check_packing(cp.run(spark, D).collect(), expected(spark, docs, D), fill=1.1)


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(None, None, "en"), (None, "a b c d e f", None), (None, "a b c d e f", None), (5, "a b c d e f g h i", "x"), (5, "a b c d e f g h i", "x"), (6, "", None), (7, "word " * 9000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame = docs
    for name, stage in cp.STAGES[:-1]:
        frame = stage(spark, frame, D)
        assert frame.columns == docs.columns, name
    kept = frame.collect()
    assert sorted(((r["doc_id"], len(r["text"] or "")) for r in kept), key=str) == [(5, 17), (6, 0), (7, 45000), (None, 11)] or \
        sorted(((r["doc_id"], len(r["text"] or "")) for r in kept), key=str) == [(5, 17), (7, 45000), (None, 0), (None, 11)]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), D).collect() == [], name


def test_near_stage_keeps_groups_that_share_an_id(spark):
    near = "one two three four five six seven eight nine ten " * 40
    far = "red orange yellow green blue indigo violet black white grey " * 40
    rows = [(5, near), (6, near), (5, far), (7, far), (None, "lorem ipsum dolor"), (None, "Lorem ipsum dolor"), (None, "sit amet elit sed")]
    kept = cp.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()
    texts = sorted((str(r["doc_id"]), r["text"].lower()) for r in kept)
    assert texts == sorted([("5", near), ("5", far), ("None", "lorem ipsum dolor"), ("None", "sit amet elit sed")])


def test_near_stage_keeps_one_row_of_a_nameless_group(spark, monkeypatch):
    # Two fingerprints one bit apart, no id: one group.
    from corvid.llm import simhash
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.selectExpr("row", "id", "cast(length(text) as long) fp"))
    docs = spark.createDataFrame([(None, "aa"), (None, "aaa"), (None, "a" * 60)], "doc_id long, text string")
    assert sorted(len(r["text"]) for r in cp.near_stage(spark, docs, D).collect()) in ([2, 60], [3, 60])
