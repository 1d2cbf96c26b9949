"""Text flows on the bound tables: notes (events, conversations), cleaned
document text, word counts, token signals and phrase flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import lexicon as lx
from corvid.operators import notes as nt
from corvid.operators import words as wd
from corvid.plans import bindings as b
from corvid.sources import spread_for_cpu

# Boilerplate prefixes for the bound note tables (case-sensitive).
EVENT_BOILERPLATE = ("View", "Purchase")
CONVERSATION_BOILERPLATE = ("The", "Der")

# A lexicon whose words occur in the generated documents (the domain
# lexicons are config and hardly occur there).  It covers negated and plain
# hits, a negation word that is itself a synonym of another key, exclusions
# that start at, straddle and end exactly at an include start.
TEST_TOKENS = (
    lx.TokenKey("insult", ("worthless", "stupid", "idiot", "trash"), ("the", "a")),
    lx.TokenKey("licence", ("license", "licensed"), ("apache", "mit")),
    lx.TokenKey("ci", ("ci",), ("no",)),
    lx.TokenKey("article", ("the",), ("of",)),
    lx.TokenKey("conj", ("und", "and", "et")),
)
TEST_PHRASES = (
    lx.PhraseKey("licence_terms", ("license",), ("apache license", "mit license")),
    lx.PhraseKey("insult_phrase", ("worthless", "trash"), ("the worthless", "a trash")),
    lx.PhraseKey("tion", ("tion",), ("ation", "tions", "en")),
    lx.PhraseKey("plain", ("idiot", "stupid")),
)


def event_notes(spark: SparkSession, d: str) -> DataFrame:
    """events as dated notes: user = claim, event id = note id.  Error events
    carry an unparsable time and signups a date without time, so parsing has
    bad rows to turn into NULL."""
    ev = b.table(spark, d, "events")
    when_text = (F.when(F.col("event_type") == "error", F.concat(F.lit("n/a "), F.col("event_id").cast("string")))
                 .when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd"))
                 .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    title = F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"))
    return ev.select(F.col("user_id").alias("claim_number"), F.col("event_id").alias("note_id"),
                     when_text.alias("transaction_date"),
                     F.concat(title, F.lit(" "), F.col("props")).alias("fnol_notes"))


def event_master(spark: SparkSession, d: str) -> DataFrame:
    """One row per user with its first event date as the notification date."""
    ev = b.table(spark, d, "events")
    return ev.groupBy(F.col("user_id").alias("claim_number")).agg(
        F.min(F.to_date("ts")).alias("claim_notification_date"))


def parsed_notes(spark: SparkSession, d: str) -> DataFrame:
    return nt.parse_note_time(event_notes(spark, d))


def notes_same_day(spark: SparkSession, d: str) -> DataFrame:
    notes = parsed_notes(spark, d).filter(F.col("fnol_notes").isNotNull())
    return nt.notes_same_day(event_master(spark, d), notes,
                             order_cols=("notes_date_time", "note_id"), prefixes=EVENT_BOILERPLATE)


def notes_all(spark: SparkSession, d: str) -> DataFrame:
    conv = b.table(spark, d, "conversations").select(
        F.col("conv_id").alias("claim_number"), "turn", F.col("text").alias("fnol_notes"))
    master = b.claims(spark, d).select("claim_number")
    return nt.notes_all(master, conv.filter(F.col("fnol_notes").isNotNull()),
                        order_cols=("turn",), prefixes=CONVERSATION_BOILERPLATE)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents")


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = spread_for_cpu(documents(spark, d).select("doc_id", "text"))
    return docs.select("doc_id", nt.clean_text_expr("text").alias("text"))


def word_count(spark: SparkSession, d: str, stop: bool) -> DataFrame:
    docs = spread_for_cpu(documents(spark, d).select("text"))
    return wd.word_count(docs, "text", wd.stop_words() if stop else None)


def token_signals(spark: SparkSession, d: str, lexicon=TEST_TOKENS) -> DataFrame:
    return lx.token_signals(clean_documents(spark, d), "text", lexicon, keep=["doc_id"])


def phrase_flags(spark: SparkSession, d: str, lexicon=TEST_PHRASES) -> DataFrame:
    return lx.phrase_flags(clean_documents(spark, d), "text", lexicon, keep=["doc_id"])
