"""URL filters from dated lists: a temporal join of captures and list entries (native operations only).

A list entry says that from a day on a key (a host, a registered domain, or a host and
first path segment) is blocked, allowed or taken off the list. The entries of a key become
validity intervals, each ending where the next begins. A capture is judged by the entries
active on the day of its fetch; the most specific key decides.

Intervals are laid out by calendar month, so the as-of join is an equality on (key, month)
and a range within it: a host with a third of all captures meets one short list per
month and is split further by the adaptive skew join, and no capture meets entries of other months.

Defined results: of entries of a key on one day block wins over allow over delist; an entry
holds on its own day; a capture without url, host or fetch day has no rule and is kept;
repeated captures are judged each; an empty list keeps everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlab.llm.common import scratch_table

ORDER = {"delist": 0, "allow": 1, "block": 2}


def host(url_col: str) -> Column:
    return F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


def match_keys(url_col: str) -> Column:
    """The keys that may name a url, as an array of (rank, key); a higher rank is more specific."""
    name = host(url_col)
    segment = F.regexp_extract(url_col, r"^[^:/?#]+://[^/?#]+/([^/?#]+)", 1)
    domain = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    keys = F.array(
        F.when((name != "") & (segment != ""), F.struct(F.lit(3).alias("rank"), F.concat(F.lit("path:"), name, F.lit("/"), segment).alias("key"))),
        F.when(name != "", F.struct(F.lit(2).alias("rank"), F.concat(F.lit("host:"), name).alias("key"))),
        F.when(domain != "", F.struct(F.lit(1).alias("rank"), F.concat(F.lit("domain:"), domain).alias("key"))))
    return F.filter(keys, lambda k: k.isNotNull())


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def validity(entries: DataFrame, until: Column) -> DataFrame:
    """(key, listed_on, valid_to, action, month): one row per month in which an entry is active;
    ``until`` is the month after which nobody asks."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("action"))
    days = (entries.filter("key is not null and listed_on is not null").withColumn("weight", weight)
            .filter("weight is not null").groupBy("key", "listed_on").agg(F.max(F.struct("weight", "action")).alias("a"))
            .select("key", "listed_on", "a.action"))
    following = F.lead("listed_on").over(Window.partitionBy("key").orderBy("listed_on"))
    held = days.withColumn("valid_to", following).filter("action <> 'delist'")
    first = _month(F.col("listed_on"))
    last = F.least(F.coalesce(_month(F.col("valid_to")), until), until)
    months = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return held.withColumn("month", F.explode(months))


def decide(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, fetched_col: str) -> DataFrame:
    """One row per capture: id, url, fetch day, rule, listed_on, decision (block, allow or none) and kept."""
    rows = scratch_table(captures.select(F.col(id_col).alias("capture"), F.col(url_col).alias("url"),
                                         F.col(fetched_col).cast("date").alias("day"),
                                         F.monotonically_increasing_id().alias("row_no")), "captures")
    until = rows.agg(F.max(_month(F.col("day")))).scalar()
    active = validity(entries, until)
    asked = rows.select("row_no", "day", F.explode(match_keys("url")).alias("k"), _month(F.col("day")).alias("month"))
    asked = asked.select("row_no", "day", "month", "k.rank", "k.key")
    hits = asked.join(active, ["key", "month"]).filter("day >= listed_on and (valid_to is null or day < valid_to)")
    best = hits.groupBy("row_no").agg(F.max(F.struct("rank", "key", "action", "listed_on")).alias("b"))
    out = rows.join(best, "row_no", "left")
    decision = F.coalesce(F.col("b.action"), F.lit("none"))
    return out.select(F.col("capture").alias(id_col), F.col("url").alias(url_col), F.col("day").alias(fetched_col),
                      F.col("b.key").alias("rule"), F.col("b.listed_on").alias("listed_on"),
                      decision.alias("decision"), (decision != "block").alias("kept"))
