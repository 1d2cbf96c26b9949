"""Notes and text queries with their SQL oracles."""

from __future__ import annotations

from corvid.operators import lexicon as lx
from corvid.operators import words as wd
from corvid.plans import oracle_text as ot
from corvid.plans import text_flow as tf
from corvid.plans.catalog import register

EVENT_NOTES = """notes AS (
  SELECT user_id AS claim_number, event_id AS note_id,
         CASE WHEN event_type = 'error' THEN 'n/a ' || CAST(event_id AS VARCHAR)
              WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d')
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS transaction_date,
         upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' ' || props AS fnol_notes
  FROM events),
parsed AS (
  SELECT *, CAST(try_strptime(transaction_date, '%Y-%m-%d %H:%M:%S') AS DATE) AS notes_date,
         try_strptime(transaction_date, '%Y-%m-%d %H:%M:%S') AS notes_date_time
  FROM notes)"""


@register("parse_note_time", f"WITH {EVENT_NOTES} SELECT * FROM parsed")
def parse_note_time(spark, d):
    """FN2: text time -> date and timestamp; bad strings -> NULL."""
    return tf.parsed_notes(spark, d)


@register("notes_same_day", f"""WITH {EVENT_NOTES},
master AS (SELECT user_id AS claim_number, min(CAST(ts AS DATE)) AS claim_notification_date
           FROM events GROUP BY user_id)
SELECT n.claim_number, n.notes_date, count(n.claim_number) AS number_of_notes,
       lower(string_agg(n.fnol_notes, '~' ORDER BY n.notes_date_time ASC NULLS FIRST,
                        n.note_id ASC NULLS FIRST, n.fnol_notes)) AS fnol_notes
FROM master m JOIN parsed n
  ON m.claim_number = n.claim_number AND m.claim_notification_date = n.notes_date
WHERE n.fnol_notes IS NOT NULL AND NOT starts_with(n.fnol_notes, 'View')
  AND NOT starts_with(n.fnol_notes, 'Purchase')
GROUP BY n.claim_number, n.notes_date""")
def notes_same_day(spark, d):
    """TX2: notes of the notification day, boilerplate dropped, ordered concat."""
    return tf.notes_same_day(spark, d)


@register("notes_all", """
SELECT c.conv_id AS claim_number, count(c.conv_id) AS number_of_notes_all,
       lower(string_agg(c.text, '~' ORDER BY c.turn ASC NULLS FIRST, c.text)) AS all_notes
FROM orders o JOIN conversations c ON o.o_orderkey = c.conv_id
WHERE c.text IS NOT NULL AND NOT starts_with(c.text, 'The') AND NOT starts_with(c.text, 'Der')
GROUP BY c.conv_id""")
def notes_all(spark, d):
    """TX3: notes of all dates per claim."""
    return tf.notes_all(spark, d)


@register("clean_text", f"SELECT doc_id, {ot.clean_sql('text')} AS text FROM documents")
def clean_text(spark, d):
    """TX1."""
    return tf.clean_documents(spark, d)


_SPLIT = r"regexp_split_to_array(text, '[\s\x0B]+')"


@register("word_count", f"""
SELECT word, count(*) AS count FROM (SELECT unnest({_SPLIT}) AS word FROM documents)
WHERE word <> '' GROUP BY word""")
def word_count(spark, d):
    """TX7: raw whitespace words, no stop-word removal."""
    return tf.word_count(spark, d, stop=False)


def _nostop_sql() -> str:
    return f"""
SELECT word, count(*) AS count FROM (SELECT unnest({_SPLIT}) AS word FROM documents)
WHERE word <> '' AND lower(word) NOT IN {ot.in_list(wd.stop_words())} GROUP BY word"""


@register("word_count_nostop", _nostop_sql)
def word_count_nostop(spark, d):
    """TX6: stop words (domain + default English) removed."""
    return tf.word_count(spark, d, stop=True)


@register("token_signals", ot.token_sql(tf.TEST_TOKENS))
def token_signals(spark, d):
    """TX8-TX11 with a lexicon that occurs in the documents."""
    return tf.token_signals(spark, d)


@register("token_signals_domain", ot.token_sql(lx.TOKEN_LEXICON))
def token_signals_domain(spark, d):
    """TX8-TX11 with the domain token lexicon."""
    return tf.token_signals(spark, d, lx.TOKEN_LEXICON)


@register("phrase_flags", ot.phrase_sql(tf.TEST_PHRASES))
def phrase_flags(spark, d):
    """TX12-TX13 with a lexicon that occurs in the documents."""
    return tf.phrase_flags(spark, d)


@register("phrase_flags_domain", ot.phrase_sql(lx.PHRASE_LEXICON))
def phrase_flags_domain(spark, d):
    """TX12-TX13 with the domain phrase lexicon."""
    return tf.phrase_flags(spark, d, lx.PHRASE_LEXICON)
