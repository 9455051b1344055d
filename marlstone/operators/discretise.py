"""Supervised binary cuts of numbers, and z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.names import column
from marlstone.operators.rules import number_text
from marlstone.operators.tables import fresh

#: Distinct values of a column that are ordered in one task; of more, about so many are dealt to each of at most MOST_RANGES ranges.
ONE_PART, MOST_RANGES = 100_000, 1000


def _values(rows: DataFrame, attrs: list[str], *more: Column) -> DataFrame:
    """(place, value, more) of every number that isn't missing: all columns in one long layout."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), column(a).cast("double").alias("value")) for i, a in enumerate(attrs)])).alias("p")
    return rows.select(*more, pairs).select("p.place", "p.value", *[F.col(f"m{i}") for i in range(len(more))]).filter(F.col("value").isNotNull())


def value_ranges(rows: DataFrame, attrs: list[str]) -> list[tuple[int, list[float]]]:
    """(place, bounds) of each column with more than one range of values: the ends of all ranges but the last, MOST_RANGES at most.

    One job for all columns. Ranges follow distinct values, not rows, and decide only which task
    orders a value, so the same ones serve any part of the rows.
    """
    shares = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    found = _values(rows, attrs).distinct().groupBy("place").agg(F.count("*").alias("n"), F.percentile_approx("value", shares, 10 * MOST_RANGES).alias("q")).collect()
    bounds = []
    for r in found:
        many = min(MOST_RANGES, -(-r["n"] // ONE_PART))
        if many > 1:
            bounds.append((r["place"], sorted({r["q"][i * MOST_RANGES // many - 1] for i in range(1, many)})))
    return bounds


def cut_candidates(rows: DataFrame, attrs: list[str] | str, class_: str, weight: str | None = None, classes: list[str] | None = None, ranges: list[tuple[int, list[float]]] | None = None) -> DataFrame:
    """(place, cut, entropy, below, above) of every candidate cut of several numbers, place being that in attrs: the middle between neighbours in the
    order of value and class that differ in both, the mean entropy of its sides, and the sides' numbers of rows by class.

    All columns are cut by one job: their values and classes are counted in one long layout, so
    what is ordered are distinct values, not rows. Running class counts are sums over
    ranges of values (value_ranges): the ranges' totals are added up, and only within a range is
    there a window. Nothing is persisted. classes are all values of the class, if they are known.
    """
    attrs = [attrs] if isinstance(attrs, str) else list(attrs)
    known = rows.filter(column(class_).isNotNull())
    if classes is None:
        classes = [r[0] for r in known.select(column(class_).cast("string").alias("c")).distinct().orderBy("c").collect()]
    if ranges is None:
        ranges = value_ranges(known, attrs)
    k = range(len(classes))
    w = column(weight).cast("long") if weight else F.lit(1).cast("long")
    long = _values(known, attrs, column(class_).cast("string").alias("m0"), w.alias("m1"))
    # one row per value: its class counts, its first and last class
    of = [F.sum(F.when(F.col("m0") == c, F.col("m1")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(classes)]
    values = long.groupBy("place", "value").agg(*of, F.min("m0").alias("first"), F.max("m0").alias("last"))
    # what follows is in SQL: its names are its own, and there is a term for each class
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    if not ranges:
        within = "PARTITION BY place ORDER BY value"
        sums = [f"coalesce(sum(n{i}) OVER ({within} {before}), 0) AS l{i}" for i in k] + [f"sum(n{i}) OVER (PARTITION BY place) AS a{i}" for i in k]
        placed = values.selectExpr("place", "value", "first", f"lag(struct(value, last)) OVER ({within}) AS prev", *sums)
    else:
        bounds = rows.sparkSession.createDataFrame(ranges, "place int, bounds array<double>")
        values = values.join(F.broadcast(bounds), "place", "left").selectExpr("*", "coalesce(size(filter(bounds, b -> b < value)), 0) AS range")
        totals = values.groupBy("place", "range").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in k], F.max(F.struct("value", "last")).alias("end"))
        by_range, within = "PARTITION BY place ORDER BY range", "PARTITION BY place, range ORDER BY value"
        sums = [f"coalesce(sum(t{i}) OVER ({by_range} {before}), 0) AS b{i}" for i in k] + [f"sum(t{i}) OVER (PARTITION BY place) AS a{i}" for i in k]
        totals = totals.selectExpr("place", "range", *sums, f"lag(end) OVER ({by_range}) AS prior")  # MOST_RANGES rows a column at most
        placed = values.join(F.broadcast(totals), ["place", "range"])
        sums = [f"b{i} + coalesce(sum(n{i}) OVER ({within} {before}), 0) AS l{i}" for i in k] + [f"a{i}" for i in k]
        placed = placed.selectExpr("place", "value", "first", f"coalesce(lag(struct(value, last)) OVER ({within}), prior) AS prev", *sums)
    below, above = ", ".join(f"l{i}" for i in k), ", ".join(f"a{i} - l{i}" for i in k)
    sides = placed.filter("prev.last <> first").selectExpr("place", "(prev.value + value) / 2 AS cut", f"cast(array({below}) AS array<bigint>) AS below", f"cast(array({above}) AS array<bigint>) AS above")
    mean = f"({_bits_of('below')} + {_bits_of('above')}) / ({rows_of('below')} + {rows_of('above')})"
    return sides.selectExpr("place", "cut", f"{mean} AS entropy", "below", "above")


def rows_of(counts: str) -> str:
    """SQL for the sum of an array of counts."""
    return f"aggregate({counts}, 0L, (a, x) -> a + x)"


def n_log_n(x: str) -> str:
    return f"if({x} > 0, {x} * log2({x}), 0D)"


def _bits_of(counts: str) -> str:
    """SQL for the entropy in bits of an array of class counts, times their sum."""
    return f"({n_log_n(rows_of(counts))} - aggregate({counts}, 0D, (a, x) -> a + {n_log_n('x')}))"


def entropy_of_counts(counts: str) -> str:
    """SQL for the entropy in bits of an array of class counts, at least one of which isn't 0."""
    return f"{_bits_of(counts)} / {rows_of(counts)}"


def best_cuts(rows: DataFrame, attrs: list[str], class_: str, weight: str | None = None, classes: list[str] | None = None, ranges: list[tuple[int, list[float]]] | None = None) -> DataFrame:
    """(attr, place, cut, entropy, below, above): of each number the cut with the least mean entropy, the smallest such cut; a column that has no candidate has no row."""
    found = cut_candidates(rows, attrs, class_, weight, classes, ranges)
    best = found.groupBy("place").agg(F.expr("min_by(struct(cut, entropy, below, above), struct(round(entropy, 12), cut)) AS x"))
    return best.select(F.get(F.lit(list(attrs)), F.col("place")).alias("attr"), "place", "x.cut", "x.entropy", "x.below", "x.above")


def best_cut(rows: DataFrame, attr: str, class_: str, weight: str | None = None, classes: list[str] | None = None) -> DataFrame:
    """(cut, entropy) with the least mean entropy, the smallest such cut; nulls where no two neighbours differ in value and class."""
    return cut_candidates(rows, attr, class_, weight, classes).agg(F.min_by("cut", F.struct(F.round("entropy", 12), "cut")).alias("cut"), F.min("entropy").alias("entropy"))


def discretise(df: DataFrame, attr: str, cut: float, name: str | None = None) -> DataFrame:
    """df with the side of a cut ('<=cut' or '>cut') as a discrete column; missing stays missing."""
    shown = number_text(cut)
    label = F.when(column(attr) <= cut, f"<={shown}").when(column(attr) > cut, f">{shown}")
    return df.withColumn(name or attr, label)


def z_scores(df: DataFrame, attrs: list[str]) -> DataFrame:
    """df with each number less its mean, by its sample deviation; missing stays missing, and a column without spread is 0."""
    names = {(n, x): fresh(df, f"_{n}_{x}") for x in attrs for n in ("mean", "dev")}
    stats = df.agg(*[f(column(x)).alias(names[n, x]) for x in attrs for n, f in (("mean", F.avg), ("dev", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for x in attrs:
        mean, dev = F.col(names["mean", x]), F.col(names["dev", x])
        z = F.when(dev > 0, (column(x) - mean) / dev).otherwise(F.lit(0.0))
        out = out.withColumn(x, F.when(column(x).isNotNull(), z))
    return out.drop(*names.values())
