"""URL filters by a temporal list join, in DataFrame operations only.

A list's dated entries (add or remove a key) become validity intervals: an addition holds until
the next entry for its key. Every capture is evaluated as of its fetch time under all
keys of its URL: the host and each domain above it (an address has none above it), and the
host with each leading part of its path.

The as-of join puts entries and captures into one order, by list, key and time, deals them to
ranges of it, and takes for a capture the last entry before it within its range. What holds where a range begins
comes from a table of the ranges' ends. So a key may have any number of captures and entries, all at one time even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import join_groups, materialise

IPV4 = "^[0-9]{1,3}([.][0-9]{1,3}){3}$"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user and port, an IPv6 address with its brackets; empty for anything else."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of a URL, without query and fragment."""
    return F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(url: Column) -> Column:
    """All keys under which lists may have a URL: 'd:' and a domain of two labels or more or an address, 'p:' and the host with leading path parts."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    address = F.startswith(host, F.lit("[")) | host.rlike(IPV4)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    domains = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.size(labels) - i >= 1),
        lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    paths = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: i <= F.size(parts)),
        lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.when(host != "", F.array_distinct(F.concat(F.when(address, F.array(F.concat(F.lit("d:"), host))).otherwise(domains), paths))).otherwise(F.array().cast("array<string>"))


def states(entries: DataFrame) -> DataFrame:
    """(list, key, at, active): whether a list holds a key from a time on, until its next row.

    Entries without key or date are passed over; of several at one time for a key a removal counts.
    """
    known = entries.filter(F.col("key").isNotNull() & F.col("at").isNotNull())
    return known.groupBy("list", "key", "at").agg((F.max((F.col("action") == "remove").cast("int")) == 0).alias("active"))


def as_of(asked: DataFrame, dated: DataFrame) -> DataFrame:
    """asked (list, key, at, url) with active, what dated (list, key, at, active) says at that time: the last of its rows up to then; null before the first."""
    order = ("list", "key", "at", "kind", "salt")
    events = dated.select("list", "key", "at", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), F.lit(None).cast("string").alias("url"), "active")
    both = events.unionByName(asked.select("list", "key", "at", F.lit(1).alias("kind"), F.xxhash64("url").alias("salt"), "url", F.lit(None).cast("boolean").alias("active")))
    ranged = materialise(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    own = F.struct("list", "key")
    ends = ranged.groupBy("part").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.max(F.when(F.col("kind") == 0, F.struct("list", "key", "at", "active"))).alias("entry"))
    same = F.col("entry.key").eqNullSafe(F.col("last.key")) & F.col("entry.list").eqNullSafe(F.col("last.list"))
    ends = ends.withColumn("state", F.when(same, F.col("entry.active")))
    through = Window.partitionBy("last").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # a key may fill several ranges
    ends = ends.withColumn("state", F.last("state", ignorenulls=True).over(through))
    before = Window.orderBy("part")  # a row for each range
    ends = ends.select("part", "first", F.lag("last").over(before).alias("prior"), F.lag("state").over(before).alias("state"))
    border = ends.filter(F.col("prior").eqNullSafe(F.col("first")) & F.col("state").isNotNull()).select(F.col("part").alias("at_part"), "first", "state")
    within = Window.partitionBy("part", "list", "key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("active", F.last("active", ignorenulls=True).over(within)).filter("kind = 1")
    found = found.join(F.broadcast(border), (F.col("part") == F.col("at_part")) & own.eqNullSafe(F.col("first")), "left")
    return found.select("list", "key", "at", "url", F.coalesce("active", "state").alias("active"))


def filter_urls(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Every capture's capture_id, blocked, n_rules (entries active at its fetch time, one per list and key), first_rule (smallest list and key).

    A capture without URL, host or fetch time matches nothing. Rows repeated under one id with
    one URL and time are one capture each in the output and count alike. An entry holds from its
    date on, to before the next one's. An empty table gives no rows; other columns are ignored.
    """
    rows = materialise(captures.select(F.col(capture_id).alias("id"), F.col(url).alias("url"), F.col(fetched).alias("at")), "captures")
    dated = rows.filter(F.col("url").isNotNull() & F.col("at").isNotNull())
    once = materialise(dated.groupBy("url", "at").agg(F.count("*").alias("copies")), "once")
    dated_entries = materialise(states(entries), "states")
    # one row for a key, and written, so that the captures of a key may be split as they meet it
    listed = materialise(dated_entries.groupBy("key").agg(F.collect_set(F.struct("list")).alias("lists")), "listed")
    keys = once.select("url", "at", F.explode(url_keys(F.col("url"))).alias("key")).join(listed, "key")
    asked = keys.select("url", "at", "key", F.explode("lists").alias("l")).select("url", "at", "key", "l.list")
    found = as_of(asked, dated_entries).filter("active").groupBy("url", "at").agg(F.count("*").alias("n_rules"), F.min(F.concat_ws(" ", "list", "key")).alias("first_rule"))
    results = materialise(once.join(found, ["url", "at"], "left"), "results")
    none = rows.filter(F.col("url").isNull() | F.col("at").isNull()).select("id", F.lit(None).cast("long").alias("n_rules"), F.lit(None).cast("string").alias("first_rule"))
    out = join_groups(dated, results, ["url", "at"], "copies").select("id", "n_rules", "first_rule").unionByName(none)
    number = F.coalesce("n_rules", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(capture_id), (number > 0).alias("blocked"), number.alias("n_rules"), "first_rule")
