"""Chat formatting by event-sourced reconstruction.

A log of events (messages opened, streamed deltas, edits, regenerations) is
partitioned by conversation, sorted by sequence and folded into the final
messages, which a template renders with a loss mask.  DataFrame functions only.

Folding is associative: a stretch of a message's events folds into one event
(an edit, if the stretch starts the text anew, else a delta).  A conversation
with many events is therefore folded by stretches of its sequence first, then
by stretches of its messages, and no task gets more than a stretch of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import written

#: Marks of the template: a turn is ``### role: text</turn>`` and a line feed.
OPEN, CLOSE = "### ", "</turn>\n"
#: Role whose texts are under the loss mask.
LEARNT = "assistant"
#: Events of a conversation, and messages of it, that are folded or rendered together at most; more are dealt to stretches.
EVENTS, MESSAGES = 256, 64

LOG_SCHEMA = "conv_id long, seq long, message long, name long, kind string, role string, text string"


def escaped(text: Column) -> Column:
    """``text`` without control strings: a backslash is put before each backslash, into each ``</turn>`` and between pairs of ``#``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("##"), F.lit("#\\#"))


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _role_out(role: Column) -> Column:
    """A role without a colon, which ends it in the template."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def _fold(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event (anew, role, text) per message and group: what its events amount to, in order.

    An event that starts a text anew (``anew``) drops what came before.  Events
    that tie in ``seq`` go by (anew first, text).
    """
    at = F.struct("seq", (~F.col("anew")).alias("later"), "text")
    got = events.groupBy(*keys, "message", "name").agg(
        F.sort_array(F.collect_list(at)).alias("events"), F.max(F.when(F.col("anew"), at)).alias("last"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"))
    counted = F.filter("events", lambda e: F.col("last").isNull() | (e >= F.col("last")))
    return got.select(*keys, "message", "name", F.col("last").isNotNull().alias("anew"), "role",
                      F.array_join(F.transform(counted, lambda e: e["text"]), "").alias("text"))


def _render(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, formatted, spans): the turns in order, and where learnt texts start and how long they are, in code points."""
    got = messages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit(": ")))
    turns = got.select(*keys, F.arrays_zip(F.transform("turns", lambda t: t["role"]).alias("role"), heads.alias("head"),
                                           F.transform("turns", lambda t: escaped(t["text"])).alias("body")).alias("turns"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
        F.when(t["role"] == LEARNT, F.array_append(acc["spans"], F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))
        .otherwise(acc["spans"]).alias("spans"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return turns.select(*keys, F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
                        F.aggregate("turns", none, step, lambda acc: acc["spans"]).alias("spans"))


def format_chats(log: DataFrame, events: int = EVENTS, messages: int = MESSAGES) -> DataFrame:
    """Rendered conversations of an event log.

    ``log`` has conv_id, seq (order of the events), message (order of the
    messages), name (tells messages of equal ``message`` apart; may be NULL),
    kind, role and text.  Kinds: ``message`` opens a message with a role and
    maybe a first text, ``delta`` appends to it, ``edit`` replaces its text
    and ``regenerate`` starts it anew with the given text, if any.  A message
    that has events but no ``message`` has the empty role.

    Returns (conv_id, part, parts, formatted, spans): a conversation of at
    most ``events`` events is one row; a longer one has a row for every
    ``messages`` values of ``message`` and its text is the parts' in order.
    Turns go by message (NULL first), role, text.  ``spans`` are the (start,
    length) of the learnt texts in ``formatted``, in code points.

    NULL conv_id is a conversation; NULL text is empty; NULL seq comes first;
    repeated rows of an event are repeated events; an empty log gives no
    rows; other columns are dropped.  A very long text is one value.
    """
    anew = F.col("kind").isin("edit", "regenerate")
    slim = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("message").cast("long").alias("message"),
                      F.col("name").cast("long").alias("name"), F.coalesce(anew, F.lit(False)).alias("anew"),
                      F.when(F.col("kind") == "message", F.coalesce("role", F.lit(""))).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Conversations of many events: a count per conversation, combined before its shuffle; written, so that Spark knows
    # the size of the list before it joins.
    many = written(slim.groupBy("conv_id").count().where(F.col("count") > events).select(F.col("conv_id").alias("c"), F.lit(True).alias("many")))
    dealt = (slim.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left")
             .withColumn("part", F.when(F.col("many"), F.coalesce(F.expr(f"message div {messages}"), F.lit(-1))))
             .withColumn("stretch", F.when(F.col("many"), F.coalesce(F.expr(f"seq div {events}"), F.lit(-1))))
             .drop("c", "many"))
    # One exchange serves both groupings: the second's keys are among the first's.
    whole = _fold(dealt.where("part IS NULL").repartition("conv_id", "part"), ["conv_id", "part"])
    pieces = _fold(dealt.where("part IS NOT NULL"), ["conv_id", "part", "stretch"]).withColumn("seq", F.col("stretch"))
    long = _fold(pieces.repartition("conv_id", "part"), ["conv_id", "part"])
    return _render(whole, ["conv_id", "part"]).unionAll(_render(long, ["conv_id", "part"]))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from ``formatted`` and ``spans``.

    ``turns_sha256`` is of ``role``, line feed, ``text``, line feed of every
    turn; ``loss_sha256`` of the texts under the mask, without escapes.
    """
    turns = F.split(F.col("formatted"), F.lit(CLOSE))
    parts = F.slice(turns, F.lit(1), F.size(turns) - 1)
    role = lambda t: _role_in(F.substring(F.substring_index(t, ":", 1), len(OPEN) + 1, 1 << 30))
    text = lambda t: unescaped(F.substr(t, F.locate(":", t) + 2))
    whole = F.array_join(F.transform(parts, lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), "")
    learnt = F.array_join(F.transform("spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    read = chats.select("conv_id", "part", F.size(parts).cast("long").alias("n_turns"), whole.alias("turns"), learnt.alias("learnt"),
                        F.length("formatted").cast("long").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", c))), lambda x: x[c]), "").alias(c)
    # Only a conversation in parts is gathered: what its digests are of.
    one = read.where("part IS NULL").drop("part")
    several = (read.where("part IS NOT NULL").groupBy("conv_id")
               .agg(F.sum("n_turns").alias("n_turns"), joined("turns"), joined("learnt"), F.sum("formatted_chars").alias("formatted_chars")))
    return one.unionAll(several).select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def log_of_turns(turns: DataFrame) -> DataFrame:
    """An event log that ends in the given turns (conv_id, turn, role, text).

    A learnt turn is opened with the start of a draft, regenerated and
    streamed in two deltas; any other is opened with a draft, edited to its
    first half and continued by a delta.  Each row is a message of its own,
    repeated rows too.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    draft = F.substring("text", 1, 16)
    head, tail = F.substr(F.col("text"), F.lit(1), half), F.substr(F.col("text"), half + 1)
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).alias("k"), kind.alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    again = F.when(F.col("role") == LEARNT, F.lit("regenerate")).otherwise(F.lit("edit"))
    events = F.array(event(0, F.lit("message"), F.col("role"), draft), event(1, again, none, head), event(2, F.lit("delta"), none, tail))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (rows.withColumn("name", F.monotonically_increasing_id()).withColumn("e", F.explode(events))
            .select("conv_id", (F.coalesce("turn", F.lit(0)) * 3 + F.col("e.k")).alias("seq"), F.col("turn").alias("message"), "name", "e.kind", "e.role", "e.text"))
