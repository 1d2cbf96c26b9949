"""URL filters by a temporal list join.

Dated list entries (a key is added to or removed from a list) become validity
intervals; an as-of join evaluates each capture against the entries that are
active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import row_keys

#: Bytes of intervals up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; NULL if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """Keys under which a URL can be listed: its host, the host's parents of two labels or more, and host/first-segment."""
    labels = F.split(host_of(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    path = F.when(segment != "", F.array(F.concat_ws("/", host_of(url), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url).isNotNull(), F.array_distinct(F.concat(parents, path))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) of (list, key, day, listed): listed from since on, before until (NULL: still).

    Of entries of one list, key and day the removal wins; a repeated state
    opens no new interval.  The state before and the next change are looked up
    within the year and, from a year's first and last entry, in the table of
    years, so a key with very many entries is no single window.
    """
    days = (entries.where("list is not null and key is not null and day is not null and listed is not null")
            .groupBy("list", "key", "day").agg(F.min("listed").alias("listed")).withColumn("year", F.year("day")))
    in_year = Window.partitionBy("list", "key", "year").orderBy("day")
    by_year = Window.partitionBy("list", "key").orderBy("year")
    last = (days.groupBy("list", "key", "year").agg(F.max_by("listed", "day").alias("last"))
            .select("list", "key", "year", F.lag("last").over(by_year).alias("earlier")))
    days = (days.withColumn("before", F.lag("listed").over(in_year)).join(last, ["list", "key", "year"])
            .where(~F.col("listed").eqNullSafe(F.coalesce("before", "earlier"))).select("list", "key", "day", "listed", "year"))
    days = days.withColumn("until", F.lead("day").over(in_year))
    years = (days.groupBy("list", "key", "year").agg(F.min("day").alias("first")))
    years = years.select("list", "key", "year", F.lead("first").over(by_year).alias("later"))
    return (days.join(years, ["list", "key", "year"]).where("listed")
            .select("list", "key", F.col("day").alias("since"), F.coalesce("until", "later").alias("until")))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
             fetched_col: str = "fetched") -> DataFrame:
    """State of every capture at its fetch day.

    Returns one row per capture: the id, url, host, fetched, blocked, lists
    (names of the lists that held one of its keys, sorted, comma-joined),
    n_rules (list and key pairs that were active) and since (the first day of
    the oldest of them).  A URL without a host, a NULL URL and a NULL day match
    nothing; repeated captures are rows of their own; an empty list blocks
    nothing; other columns are dropped.  Entries are (list, key, day, listed);
    those with a NULL are ignored.
    """
    slim = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(fetched_col).cast("date").alias("fetched"))
    rows = row_keys(slim, "row")
    active = intervals(entries).checkpoint()
    held = active.agg(F.sum(F.octet_length("list") + F.octet_length("key") + F.lit(48))).first()[0] or 0
    if held <= BROADCAST_BYTES:
        active = F.broadcast(active)
    probes = rows.select("row", "fetched", F.explode_outer(keys_of(F.col("url"))).alias("key")).where("key is not null and fetched is not null")
    hits = (probes.join(active, "key").where("since <= fetched and (until is null or fetched < until)")
            .groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
                                F.count("*").alias("n_rules"), F.min("since").alias("since")))
    return rows.join(hits, "row", "left").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), host_of(F.col("url")).alias("host"), F.col("fetched").alias(fetched_col),
        F.col("n_rules").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), "since")
