"""Pieces that several operators share: shared scratch tables, skew-proof joins, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.files import scratch_path

#: A key with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE of them, so a table of hot keys can be broadcast.
HOT_SHARE = 1000
#: Large-star/small-star needs about log2(longest chain) rounds; beyond this something is wrong.
MAX_ROUNDS = 60


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def give_back() -> None:
    """Memory that Python and Arrow no longer use goes back to the system, which a process that lives long else keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def let_go(spark: SparkSession) -> None:
    """The driver lets go of the broadcasts and shuffles of results that are written: Spark cleans up behind objects once the driver's JVM has collected them, and its heap shrinks."""
    give_back()
    spark.sparkContext._jvm.System.gc()


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """A worker's model: made once, and let go as soon as the worker needs another, so that a worker holds one at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """Join of rows with one row per key, where keys may hold a third of all rows.

    groups must have the number of rows of each key in column size, and both inputs should be
    materialised. Hot keys (more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys) are
    joined by broadcast and never shuffled; all others by a shuffle in which no key is large.
    With how = "left", rows whose key isn't in groups stay.
    """
    keys = [key] if isinstance(key, str) else key
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    least = max(1, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > least)
    cold = groups.filter(F.col(size) <= least)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as (src, dst) longs: (node, component) with the smallest node as component.

    Alternates large-star and small-star steps until the edges are stars around the
    smallest nodes; every step is a group-by and a join on edges, nothing is collected. The join's
    other side has one row per node, so adaptive execution may split a hub's rows. Nodes
    without edges don't appear. Nulls are ignored, repeated edges and loops are harmless.
    """
    now = materialise(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u > v").distinct(), "edges"
    )
    before = None
    for _ in range(MAX_ROUNDS):
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u > v")
            .distinct()
        )
        now = materialise(small, "edges")
    raise RuntimeError("connected components didn't settle")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links a[i]-b[i]; vectorised label spreading with pointer jumping."""
    low = np.arange(n)
    while a.size:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
        rest = low[a] != low[b]
        a, b = a[rest], b[rest]
    return low
