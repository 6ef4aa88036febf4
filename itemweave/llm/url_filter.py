"""URL filters with dated lists, with DataFrame operations only.

A list is a log of dated entries: at ``ts``, a pattern is set to an action. An entry is valid from its own date up to that
of the next entry for its pattern, so the log becomes intervals [start, end). A pattern is a host, which covers its
subdomains, or a host with the beginning of a path, which covers the whole path segments below it, for this host alone. Every capture is
evaluated against the entries that are active when it was fetched; among these the most specific pattern, the longest, decides.

A capture asks for each pattern that can cover it, one for each label of its host and each segment of its path, in
an equality join on (pattern, period): intervals are laid out by periods of ``period_days``, a capture falls into one. So a
pattern with a long history, or a host with a third of all captures, is spread over its periods, and no window function
sees all rows of a key. A period in which a pattern has many entries is cut into as many slots, so that a capture meets few of
them however many a hot host has, if they are spread over the period. Patterns are looked up once for each distinct (URL, fetch time), and only intervals of patterns that
occur travel.

Defined cases: entries or captures with a NULL time, pattern or URL match nothing; of entries for one pattern at one time
the least action in alphabetical order counts ("allow" before "block"); repeated captures each get the result; empty tables give an empty result or no match; a URL without
scheme is read from its host on; upper-case hosts, ports, user names, queries and fragments do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemweave.llm.common import Scratch, small

PERIOD_DAYS = 7


def host(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; empty for a URL without one."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    return F.lower(F.regexp_extract(rest, r"^(?://)?(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path(url: Column) -> Column:
    """The path without query, fragment, empty segments at its end; starts with /, or is empty."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?[^/?#]*", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*)", 1), r"/+$", "")


def patterns(h: Column, p: Column) -> Column:
    """Every pattern that covers a capture: its host, the domains above it, and the host with each beginning of the path."""
    labels, segments = F.split(h, r"\."), F.split(p, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    below = F.when(p != "", F.transform(F.sequence(F.lit(2), F.greatest(F.size(segments), F.lit(2))),
                                        lambda k: F.concat(h, F.array_join(F.slice(segments, 1, k), "/"))))
    return F.when(h != "", F.array_distinct(F.concat(domains, F.coalesce(below, F.array().cast("array<string>")))))


def intervals(entries: DataFrame, period_days: int = PERIOD_DAYS) -> DataFrame:
    """pattern, action, start, end (NULL: open) and period for each period an entry is valid in, up to the last entry's.

    ``entries`` has the columns pattern, ts and action. The next entry is the next in the same period, or else the first
    of the pattern's next period with entries; so no sort sees more than one period's entries, or one row a period.
    """
    e = (entries.where("pattern IS NOT NULL AND ts IS NOT NULL").groupBy("pattern", "ts").agg(F.min("action").alias("action"))
         .withColumn("period", _period(F.col("ts"), period_days)))
    within = Window.partitionBy("pattern", "period").orderBy("ts")
    e = e.withColumn("next", F.lead("ts").over(within))
    firsts = e.groupBy("pattern", "period").agg(F.min("ts").alias("first"))
    later = firsts.withColumn("following", F.lead("first").over(Window.partitionBy("pattern").orderBy("period"))).drop("first")
    e = e.join(later, ["pattern", "period"]).withColumn("end", F.coalesce("next", "following"))
    last = F.coalesce(_period(F.col("end") - F.expr("INTERVAL 1 MICROSECOND"), period_days), F.col("period"))
    closed = e.withColumn("period", F.explode(F.sequence("period", last)))
    return closed.select("pattern", "action", F.col("ts").alias("start"), "end", "period")


def _slot(micros: Column, period_days: int) -> Column:
    """The slot, of ``slots`` even ones of a ``period``, that a time in it falls into; it never falls as time goes on."""
    length = period_days * 86_400_000_000
    return F.least(F.floor((micros - F.col("period") * F.lit(length)) / F.lit(length) * F.col("slots")).cast("long"), F.col("slots") - 1)


def _cut(spans: DataFrame, sizes: DataFrame, period_days: int) -> DataFrame:
    """Intervals by slot: with as many slots as a pattern has intervals in a period, there are at most twice as many rows."""
    length = period_days * 86_400_000_000
    begin = F.col("period") * F.lit(length)
    rows = spans.join(sizes, ["pattern", "period"], "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    first = _slot(F.greatest(F.unix_micros(F.col("start").cast("timestamp")), begin), period_days)
    last = _slot(F.least(F.coalesce(F.unix_micros(F.col("end").cast("timestamp")), begin + length), begin + length) - 1, period_days)
    return rows.withColumn("slot", F.explode(F.sequence(first, last))).drop("slots")


def _period(ts: Column, days: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(days * 86_400_000_000)).cast("long")


def evaluate(captures: DataFrame, entries: DataFrame, period_days: int = PERIOD_DAYS, url: str = "url",
             fetched: str = "fetched") -> DataFrame:
    """``captures`` with pattern, since and action of the entry that decides (NULL if none is active), which replace columns of these names."""
    scratch = Scratch(captures.sparkSession)
    spans = scratch.save(intervals(entries, period_days), "intervals")
    # The last entry of each pattern stays valid; captures after its period find it here.
    open_ended = scratch.save(spans.where("end IS NULL").select("pattern", "action", F.col("start").alias("since"), F.col("period").alias("from_period")), "open")
    asked = captures.select(F.col(url).alias("__url"), F.col(fetched).alias("__at")).where("__url IS NOT NULL AND __at IS NOT NULL").distinct()
    asked = asked.withColumns({"__h": host(F.col("__url")), "__p": path(F.col("__url")), "period": _period(F.col("__at"), period_days)})
    asked = scratch.save(asked.select("__url", "__at", "period", F.explode_outer(patterns(F.col("__h"), F.col("__p"))).alias("pattern"))
                         .where("pattern IS NOT NULL"), "asked")
    # Where a pattern has many entries in a period, captures meet those of their slot only.
    sizes = scratch.save(spans.groupBy("pattern", "period").agg(F.count(F.lit(1)).alias("slots")).where("slots > 1"), "sizes")
    sizes = small(sizes, 100_000)
    in_time = (F.col("start") <= F.col("__at")) & (F.col("end").isNull() | (F.col("__at") < F.col("end")))
    slotted = (asked.join(sizes, ["pattern", "period"], "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
               .withColumn("slot", _slot(F.unix_micros(F.col("__at").cast("timestamp")), period_days)).drop("slots"))
    met = (slotted.join(_cut(spans, sizes, period_days), ["pattern", "period", "slot"]).where(in_time)
           .select("__url", "__at", "pattern", "action", F.col("start").alias("since")))
    late = asked.join(small(open_ended, 100_000), "pattern").where("period > from_period").select("__url", "__at", "pattern", "action", "since")
    best = met.union(late).groupBy("__url", "__at").agg(
        F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since", "action")).alias("__best"))
    out = captures.join(best, (F.col(url) == F.col("__url")) & (F.col(fetched) == F.col("__at")), "left")
    found = [F.col("__best")[c].alias(c) for c in ("pattern", "since", "action")]
    return out.select(*[captures[c] for c in captures.columns if c not in ("pattern", "since", "action")], *found)
