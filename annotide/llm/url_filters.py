"""URL filters by a temporal list join.

List events (a key is listed with an action, or taken off, on a date) become
validity intervals.  A capture asks for the keys of its URL - the host, every
parent domain, and both with the first path segment - and an as-of join
finds the entries active when it was fetched.  Captures and intervals meet by
key and by period of the date, so a common host spreads over the periods.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.llm.common import quoted, without

#: Days in a period of the join.
PERIOD_DAYS = 32


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a final dot, an IPv6 address in its brackets; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1), F.lit(""))), r"\.$", "")


def segment_of(url: Column) -> Column:
    """The first path segment with the slash before it; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]+)", 1), F.lit(""))


def keys_of(host: Column, segment: Column) -> Column:
    """Keys of a URL as (key, rank); a higher rank is more specific.

    Domains of two labels at least, by rising length, each without and with
    the path segment: ranks 0 and 1 for the shortest domain, then 2 and 3.
    An IP address has no parents: its only domain is itself.
    """
    address = host.rlike(r"^(\d+\.\d+\.\d+\.\d+|\[.*\])$")
    labels = F.when(address, F.array(F.lit(""), host)).otherwise(F.split(host, r"\."))
    size = F.when(host == "", F.lit(0)).otherwise(F.size(labels))

    def domain(n: Column) -> Column:
        return F.when(address, host).otherwise(F.array_join(F.slice(labels, size - n + 1, n), "."))

    def both(n: Column) -> Column:
        plain = F.struct(domain(n).alias("key"), ((n - 2) * 2).alias("rank"))
        longer = F.struct(F.concat(domain(n), segment).alias("key"), ((n - 2) * 2 + 1).alias("rank"))
        return F.when(segment == "", F.array(plain)).otherwise(F.array(plain, longer))

    return F.when(size >= 2, F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), both))).otherwise(
        F.array().cast("array<struct<key:string,rank:int>>")
    )


def intervals(events: DataFrame) -> DataFrame:
    """``events(key, date, action)`` as (key, action, valid_from, valid_to), the end not included.

    Each event ends the one before; an action "off" opens no interval.  Of
    several events of a key on one day the one last in order of action
    counts.  Events without key, date or action are ignored.
    """
    known = events.where("key is not null and date is not null and action is not null")
    daily = known.groupBy("key", "date").agg(F.max("action").alias("action"))
    until = F.lead("date").over(Window.partitionBy("key").orderBy("date"))
    return daily.select("key", "action", F.col("date").alias("valid_from"), until.alias("valid_to")).where("action <> 'off'")


def filtered(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with host, n_active, verdict, matched_key and active_since.

    Of the entries active on the fetch date the most specific decides, then
    the latest listed, then the first key; verdict is its action, "none"
    without any.  Null or unreadable URLs and null dates match no entry.  Rows
    that repeat a key, URL and date get one verdict each.  Columns with these
    names are replaced.
    """
    made = ["host", "n_active", "verdict", "matched_key", "active_since"]
    rows = without(captures, made).withColumn("host", host_of(quoted(url)))
    period = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / PERIOD_DAYS)
    asked = (
        rows.select(quoted(url).alias("__url"), quoted(fetched).alias("__day"), "host")
        .where("__url is not null and __day is not null")
        .distinct()  # one question for each URL and day, however often it was captured
    )
    keys = asked.withColumn("__key", F.explode(keys_of(F.col("host"), segment_of(F.col("__url"))))).select(
        "__url", "__day", F.col("__key.key").alias("key"), F.col("__key.rank").alias("rank"), period(F.col("__day")).alias("__period")
    )
    last = asked.agg(F.max("__day").alias("__last"))  # one row
    spans = intervals(events).join(F.broadcast(last)).where("valid_from <= __last")
    covered = F.sequence(period(F.col("valid_from")), period(F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("__last")), F.col("__last"))))
    spread = spans.withColumn("__period", F.explode(covered)).drop("__last")
    active = keys.join(spread, ["key", "__period"]).where("valid_from <= __day and (valid_to is null or __day < valid_to)")
    order = F.struct(F.col("rank"), F.col("valid_from"))
    top = Window.partitionBy("__url", "__day")
    ranked = active.withColumns({"__n": F.count("*").over(top), "__row": F.row_number().over(top.orderBy(F.desc("rank"), F.desc("valid_from"), "key"))})
    best = ranked.where("__row = 1").select("__url", "__day", "__n", "action", "key", "valid_from")
    same = (quoted(url) == F.col("__url")) & (quoted(fetched) == F.col("__day"))
    return rows.join(best, same, "left").select(
        *[quoted(c) for c in rows.columns],
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("action", F.lit("none")).alias("verdict"),
        F.col("key").alias("matched_key"),
        F.col("valid_from").alias("active_since"),
    )
