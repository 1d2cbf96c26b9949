"""Word counts over raw text (TX4-TX7, FN6, FN9, FN10, FL9, AG13, SO2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domain stop words added to Spark's default English list
# (64 entries with one repeat), in the source order.
DOMAIN_STOP_WORDS = (
    "policy", "holder", "insured", "the", "them", "ph", "tp", "tpy", "insd", "insured", "ins",
    "caused", "causing", "whilst", "third", "party", "claim", "onto", "due", "failed", "customer",
    "client", "clients", "insureds", "working", "customers", "contractor", "claimant", "cause",
    "recoveries", "unknown", "and", "also", "advised", "call", "called", "damage", "email", "sent",
    "received", "contact", "back", "diary", "update", "bvs", "next", "payment", "note", "crawford",
    "vat", "mr", "excess", "mrs", "miss", "ms", "dr", "sedgwick", "cunningham", "lindsay",
    "xactware", "oriel", "payments", "eft", "axa",
)

WHITESPACE = r"\s+"


def default_stop_words(language: str = "english") -> list[str]:
    """Spark's bundled stop-word list.  Through the JVM when a session runs,
    otherwise read from the MLlib jar shipped with pyspark (so SQL can be
    generated without starting Spark)."""
    from pyspark import SparkContext
    if SparkContext._active_spark_context is not None:
        from pyspark.ml.feature import StopWordsRemover
        return list(StopWordsRemover.loadDefaultStopWords(language))
    import glob
    import os
    import zipfile

    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    with zipfile.ZipFile(jars[0]) as z:
        text = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
    return [w for w in text.split("\n") if w]


def stop_words(extra: Iterable[str] = DOMAIN_STOP_WORDS, language: str = "english") -> list[str]:
    """TX4 + ST2: domain words united with the default list, de-duplicated
    (sorted, so the list is the same on every run)."""
    return sorted(set(extra) | set(default_stop_words(language)))


def word_count(df: DataFrame, col: str, stop: Iterable[str] | None = None) -> DataFrame:
    """TX6 / TX7 (FN6 -> FN10 -> FN9 -> FL9 -> AG13 -> SO2): word frequencies,
    most frequent first, ties by word.

    ``stop`` removes words whose lower-case form is listed (the stop-word
    remover's case-insensitive default).  The list is config-sized, so the
    test is a hash-set membership inside codegen; counting is a hash
    aggregate combined map-side, so a very common word is pre-counted in
    every partition before the shuffle.
    """
    # The non-blank runs are exactly the non-empty pieces of the whitespace
    # split (FN6 + FL9); extracting them scales with executor threads where
    # ``split`` did not.
    words = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(r"\S+"), 0)).alias("word"))
    if stop is not None:
        words = words.filter(~F.lower(F.col("word")).isin(sorted(set(stop))))
    return words.groupBy("word").count().orderBy(F.desc("count"), F.asc("word"))
