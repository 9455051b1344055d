"""Information measures over class counts, as aggregations.

Rows may carry a weight (a count of equal rows), so that a table can be reduced to its distinct
rows first. Rows without class are an error in classification and are dropped here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The entropy of no rows.
EMPTY_ENTROPY = 1000.0


def plogp(p: Column) -> Column:
    """p log2 p, 0 for 0."""
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")


def class_counts(rows: DataFrame, class_: str, *by: str, weight: str | None = None) -> DataFrame:
    return rows.filter(F.col(class_).isNotNull()).groupBy(*by, class_).agg(F.sum(_weight(weight)).alias("n"))


def entropy(rows: DataFrame, class_: str, *by: str, weight: str | None = None) -> DataFrame:
    """Shannon entropy of the class in bits, for all rows or for each group; EMPTY_ENTROPY for an empty table."""
    counts = class_counts(rows, class_, *by, weight=weight)
    total = F.sum("n").over(Window.partitionBy(*by)) if by else None
    if by:
        return counts.withColumn("p", F.col("n") / total).groupBy(*by).agg(F.sum(-plogp(F.col("p"))).alias("entropy"))
    # n/N log n/N summed: (sum n log n) / N - log N, in one pass
    agg = counts.agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return agg.select(F.coalesce(F.log2(F.col("N").cast("double")) - F.col("s") / F.col("N"), F.lit(EMPTY_ENTROPY)).alias("entropy"))


def _contingency(rows: DataFrame, attrs: list[str], class_: str, weight: str | None) -> DataFrame:
    """(attr, value, class, n) of several attributes in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])).alias("x")
    long = rows.select(F.col(class_).alias("class"), _weight(weight).alias("w"), pairs).filter("class is not null")
    return long.filter("x.value is not null").groupBy("x.attr", "x.value", "class").agg(F.sum("w").alias("n"))


def info_gain(rows: DataFrame, attrs: list[str], class_: str, weight: str | None = None) -> DataFrame:
    """(attr, gain): entropy of the class less its mean entropy within the attribute's values; rows without value are left out for that attribute."""
    return _gain(_contingency(rows, attrs, class_, weight), lift=False)


def info_gain_lift(rows: DataFrame, attrs: list[str], class_: str, weight: str | None = None) -> DataFrame:
    """(attr, gain): the variant that puts lift P(a|c)/P(a) where the standard formula has P(c|a)."""
    return _gain(_contingency(rows, attrs, class_, weight), lift=True)


def info_gain_cut(rows: DataFrame, attr: str, cut: float, class_: str, lift: bool = False, weight: str | None = None) -> DataFrame:
    """(attr, gain) of a number's split into <= cut and > cut."""
    side = F.when(F.col(attr).isNotNull(), F.when(F.col(attr) <= cut, "0").otherwise("1"))
    binned = rows.select(F.col(class_), *([F.col(weight)] if weight else []), side.alias(attr))
    return (info_gain_lift if lift else info_gain)(binned, [attr], class_, weight)


def _gain(table: DataFrame, lift: bool) -> DataFrame:
    by_attr = Window.partitionBy("attr")
    t = (
        table.withColumn("total", F.sum("n").over(by_attr))
        .withColumn("na", F.sum("n").over(Window.partitionBy("attr", "value")))
        .withColumn("nc", F.sum("n").over(Window.partitionBy("attr", "class")))
        .withColumn("k", F.count("*").over(Window.partitionBy("attr", "class")))
    )
    class_part = -plogp(F.col("nc") / F.col("total")) / F.col("k")  # once per class, whatever its number of values
    if lift:
        x = (F.col("n") / F.col("nc")) / (F.col("na") / F.col("total"))
        within = (F.col("na") / F.col("total")) * x * F.log2(x)
    else:
        within = (F.col("na") / F.col("total")) * plogp(F.col("n") / F.col("na"))
    return t.groupBy("attr").agg((F.sum(class_part) + F.sum(within)).alias("gain"))


def split_entropy(rows: DataFrame, attr: str, cut: float, class_: str, weight: str | None = None) -> DataFrame:
    """Mean class entropy of the two sides of a cut, weighted by their rows."""
    known = rows.filter(F.col(attr).isNotNull() & F.col(class_).isNotNull())
    side = known.withColumn("side", F.col(attr) <= cut).groupBy("side", class_).agg(F.sum(_weight(weight)).alias("n"))
    t = side.withColumn("ns", F.sum("n").over(Window.partitionBy("side"))).withColumn("p", F.col("n") / F.col("ns"))
    return t.agg((F.sum(-F.col("ns") * plogp(F.col("p"))) / F.sum("n")).alias("entropy"))


def extremum(rows: DataFrame, value: str, place: str) -> DataFrame:
    """Largest and smallest value with the first place at which each stands."""
    return rows.agg(
        F.max(value).alias("max"),
        F.min(value).alias("min"),
        F.min_by(place, F.struct((-F.col(value)).alias("v"), F.col(place))).alias("max_at"),
        F.min_by(place, F.struct(F.col(value).alias("v"), F.col(place))).alias("min_at"),
    )
