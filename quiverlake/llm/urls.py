"""URL filters with a history: every capture is judged by the list as it was when it was fetched.

A list is a table of dated events (pattern, action, day). A pattern is a host, which covers its subdomains, or a host
and a path prefix of whole segments. Events of a pattern become validity intervals, from an ``add`` to the next
``remove``; intervals of one pattern never overlap, so the as-of join of a capture's own patterns with the intervals finds
at most one of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stored

#: Up to so many intervals with so many bytes of patterns in all, the list is broadcast.
BROADCAST_INTERVALS, BROADCAST_BYTES = 100_000, 51_200_000
#: Beyond, a pattern's captures are dealt to so many partitions, each with its own copy of the pattern's intervals.
SALTS = 32
FOREVER = "9999-12-31"


def host(url: str) -> Column:
    """Host in lower case, without user, port and the dot at the end; empty where there is none."""
    rest = F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(rest), r"\.$", "")


def path(url: str) -> Column:
    """Path without query and fragment and without slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), r"^/+|/+$", "")


def intervals(events: DataFrame) -> DataFrame:
    """pattern, valid_from and valid_to (exclusive) of each time that a pattern was on the list.

    ``events`` has pattern, action (add or remove) and day. An add while the pattern is listed, and a remove while it
    isn't, change nothing; of an add and a remove on one day the remove is last. Events with a null, another action or an
    empty pattern are no events. Patterns are compared in lower case, without slashes at the end.
    """
    clean = F.regexp_replace(F.lower("pattern"), r"/+$", "")
    rows = events.select(clean.alias("pattern"), (F.col("action") == "add").alias("on"), F.col("day").cast("date").alias("day"), "action")
    rows = rows.filter("action in ('add', 'remove')").filter(F.length("pattern") > 0).select("pattern", "on", "day").dropna()
    state = rows.groupBy("pattern", "day").agg(F.min("on").alias("on"))
    order = Window.partitionBy("pattern").orderBy("day")
    turns = state.withColumn("before", F.lag("on", 1, False).over(order)).filter("on != before")
    until = F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date"))
    return turns.withColumn("valid_to", until).filter("on").select("pattern", F.col("day").alias("valid_from"), "valid_to")


def patterns(url: str, segments: int) -> Column:
    """What could list a URL: its host and the domains above it, each alone and with up to ``segments`` path segments."""
    labels, parts = F.split(host(url), r"\."), F.filter(F.split(path(url), "/"), lambda x: x != "")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(segments))), lambda n: F.when(n > 0, F.concat(F.lit("/"), F.lower(F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(""))
    return F.when(host(url) != "", F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))))


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with n_active (patterns of the list that covered the URL on the day it was fetched), blocked
    (whether there were any), rule (the longest of them, of equals the first by code point) and listed_on (since when).

    A capture with a null URL or day, or a URL without a host, is not blocked. Rows may repeat, and all columns stay, but
    for those with the names of new ones. Each URL and day is judged once. The intervals are counted and measured first: few are
    broadcast; many are joined by pattern and salt, so one busy host spreads over ``SALTS`` partitions.
    """
    spans = stored(intervals(events), "intervals")
    size = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.size(F.split("pattern", "/"))) - 1, F.lit(0)).alias("segments")).first()
    u, d = F.col(f"`{url}`"), F.col(f"`{fetched}`").cast("date")
    asked = captures.select(u.alias("__url"), d.alias("__day")).dropna().distinct()
    keys = asked.withColumn("pattern", F.explode(patterns("__url", size.segments)))
    if size.n <= BROADCAST_INTERVALS and size.bytes <= BROADCAST_BYTES:
        hits = keys.join(F.broadcast(spans), "pattern")
    else:
        spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = keys.withColumn("salt", F.pmod(F.xxhash64("__url", "__day"), F.lit(SALTS)).cast("int")).join(spans, ["pattern", "salt"])
    hits = hits.filter((F.col("__day") >= F.col("valid_from")) & (F.col("__day") < F.col("valid_to")))
    best = F.min(F.struct((-F.length("pattern")).alias("size"), "pattern", "valid_from")).alias("best")
    verdict = hits.groupBy("__url", "__day").agg(F.count("*").alias("__n"), best)
    out = captures.drop("n_active", "blocked", "rule", "listed_on")
    out = out.join(verdict, (u == F.col("__url")) & (d == F.col("__day")), "left")
    return out.select(*[out[c] for c in captures.columns if c not in ("n_active", "blocked", "rule", "listed_on")], F.coalesce("__n", F.lit(0).cast("long")).alias("n_active"), F.col("__n").isNotNull().alias("blocked"), F.col("best.pattern").alias("rule"), F.col("best.valid_from").alias("listed_on"))
