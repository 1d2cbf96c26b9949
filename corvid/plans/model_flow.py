"""Model flow on the bound tables: labelled documents -> cleaned text ->
token signals + phrase flags -> numeric matrix -> folds -> learners."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import balance as bl
from corvid.operators import evaluate as ev
from corvid.operators import lexicon as lx
from corvid.operators import matrix as mx
from corvid.operators import notes as nt
from corvid.operators import quality
from corvid.plans import bindings as b
from corvid.plans import text_flow as tf
from corvid.sources import spread_for_cpu

LABEL = "toxic"
ID = "doc_id"
TOKEN_FEATURES = tuple(sorted(e.key for e in tf.TEST_TOKENS))
PHRASE_FEATURES = tuple(sorted(e.key for e in tf.TEST_PHRASES))
# n_chars and quality are numbers, source is text that does not parse (-> 0).
MATRIX_FEATURES = ("n_chars", "quality", "source", *TOKEN_FEATURES, *PHRASE_FEATURES)


def labelled_text(spark: SparkSession, d: str) -> DataFrame:
    docs = spread_for_cpu(b.table(spark, d, "documents").select(ID, "n_chars", "source", "text"))
    labels = b.table(spark, d, "labels")
    return labels.join(docs, ID).select(ID, "n_chars", "quality", "source", LABEL,
                                        nt.clean_text_expr("text").alias("text"))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """FM1 + FN8 over text features computed in the same pass."""
    base = labelled_text(spark, d)
    keep = [ID, "n_chars", "quality", "source", LABEL]
    feats = lx.token_signals(base, "text", tf.TEST_TOKENS, keep=[*keep, "text"])
    feats = lx.phrase_flags(feats, "text", tf.TEST_PHRASES, keep=[*keep, *TOKEN_FEATURES])
    return mx.numeric_matrix(feats, MATRIX_FEATURES, LABEL, keep=[ID])


def folds(spark: SparkSession, d: str, k: int = 5, rows_per_bucket: int | None = None) -> DataFrame:
    labels = b.table(spark, d, "labels").select(ID, LABEL)
    kw = {} if rows_per_bucket is None else {"rows_per_bucket": rows_per_bucket}
    return ev.stratified_folds(labels, LABEL, ID, k=k, **kw)


def fold_matrix(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """Matrix rows (``made``, if given) with their fold, as (doc_id, features vector, label, fold)."""
    m = (made or matrix(spark, d)).join(folds(spark, d).select(ID, "fold"), ID)
    return mx.assemble(m, MATRIX_FEATURES, LABEL, keep=[ID, "fold"])


def _gnb_counts(data: DataFrame) -> DataFrame:
    gnb = [lr for lr in ev.learners() if lr.name == "Gaussian Naive Bayes"]
    return ev.cross_validate(data, gnb, parallel=5)


def gnb_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _gnb_counts(fold_matrix(spark, d))


def gnb_scores(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    return ev.mean_scores(ev.fold_scores(_gnb_counts(fold_matrix(spark, d, made))))


def gnb_scores_smote(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """ML1 + ML3: the same scores on the set oversampled 1:1 before folding."""
    return ev.mean_scores(ev.fold_scores(_gnb_counts(smote_fold_matrix(spark, d, made=made))))


def gnb_scores_smotenc(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """ML2 + ML13: the same scores on the mixed-type oversampled set."""
    return ev.mean_scores(ev.fold_scores(_gnb_counts(smotenc_fold_matrix(spark, d, made=made))))


def best_model(spark: SparkSession, d: str) -> DataFrame:
    """AG18 + AG19: score table and best variant of one learner on the plain and the two oversampled sets."""
    names = ("Plain", "Oversampled", "Mixed-type oversampled")
    made = matrix(spark, d).checkpoint()   # the text features of all three
    parts = [f(spark, d, made).withColumn("model", F.lit(n)) for n, f in zip(names, (gnb_scores, gnb_scores_smote, gnb_scores_smotenc))]
    return ev.score_table(parts[0].unionByName(parts[1]).unionByName(parts[2]), names)


# Continuous / categorical split of the matrix columns for mixed-type
# oversampling, by name: counts and sizes are continuous, the 0/+-1 text
# features are categorical.
NC_CONTINUOUS = ("n_chars", "quality", "source")
NC_CATEGORICAL = tuple(c for c in MATRIX_FEATURES if c not in NC_CONTINUOUS)
SMOTE = {"k": 5, "ratio": 1.0, "seed": 11}
SMOTE_NC = {"k": 5, "ratio": 0.2, "seed": 101}


def _as_arrays(m: DataFrame) -> DataFrame:
    return m.select(ID, F.array(*[F.col(c) for c in MATRIX_FEATURES]).alias("_x"), LABEL)


def _balanced_folds(bal: DataFrame, k: int) -> DataFrame:
    """Folds over a balanced set in its row order: originals by id, then the
    synthetic rows by sample number (the order oversampling returns)."""
    bal = bal.checkpoint()   # read for the offset, the class sizes and the ranks
    offset = bal.agg(F.max(ID)).first()[0] + 1
    order = F.when(F.col("synthetic"), F.lit(offset) + F.col("sample")).otherwise(F.col(ID))
    return ev.stratified_folds(bal.withColumn("_ord", order), LABEL, "_ord", k)


def smote_fold_matrix(spark: SparkSession, d: str, k: int = 5, made: DataFrame | None = None) -> DataFrame:
    """ML1 then WN5: the matrix oversampled 1:1 before folding (the source
    flow; synthetic rows reach the test folds, Q28)."""
    bal = bl.smote(_as_arrays(made or matrix(spark, d)), ID, "_x", LABEL, **SMOTE)
    folded = _balanced_folds(bal, k)
    return folded.select(array_to_vector("_x").alias("features"),
                         F.col(LABEL).cast("double").alias("label"), "fold")


def smotenc_rows(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """ML2: originals and synthetic rows of the matrix."""
    return bl.smote_nc(made or matrix(spark, d), ID, NC_CONTINUOUS, NC_CATEGORICAL, LABEL, **SMOTE_NC)


def smotenc_fold_matrix(spark: SparkSession, d: str, k: int = 5, made: DataFrame | None = None) -> DataFrame:
    """ML2 then WN5: mixed-type oversampling to minority/majority 0.2."""
    folded = _balanced_folds(smotenc_rows(spark, d, made), k)
    return mx.assemble(folded, MATRIX_FEATURES, LABEL, keep=["fold"])


def smote_in_fold(k: int = 5, ratio: float = 1.0, seed: int = 11):
    """Training-split transform: oversample only the k-1 training folds, so
    no synthetic row is ever scored."""
    def transform(train: DataFrame, fold: int) -> DataFrame:
        arr = train.select("_id", vector_to_array("features").alias("_x"), "label")
        bal = bl.smote(arr, "_id", "_x", "label", k, ratio, seed)
        return bal.select(array_to_vector("_x").alias("features"), "label")
    return transform


def model_scores(spark: SparkSession, d: str, balance: str = "global", parallel: int = 8,
                 chosen=None) -> tuple[DataFrame, DataFrame]:
    """ML3-ML13: (long scores, score table) for a balancing mode:
    ``global`` (oversample, then fold: the source flow), ``global_nc``
    (mixed-type oversampling to 0.2, then fold), ``in_fold`` (fold, then
    oversample each training split) or ``none``."""
    if balance == "global":
        return ev.evaluate(smote_fold_matrix(spark, d), chosen, parallel=parallel)
    if balance == "global_nc":
        return ev.evaluate(smotenc_fold_matrix(spark, d), chosen, parallel=parallel)
    if balance == "in_fold":
        data = fold_matrix(spark, d).withColumn("_id", F.col(ID))
        return ev.evaluate(data, chosen, parallel=parallel,
                           train_transform=smote_in_fold(**SMOTE))
    if balance == "none":
        return ev.evaluate(fold_matrix(spark, d), chosen, parallel=parallel)
    raise ValueError(f"unknown balance mode {balance!r}")


def class_sizes(spark: SparkSession, d: str) -> DataFrame:
    return quality.class_sizes(b.table(spark, d, "labels"), LABEL)
