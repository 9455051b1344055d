"""Selection of items for one target item: odds ratio, correlation, and two kinds of Relief.

All but Relief need only counts of single items and pairs, which come from the distinct rows in
one aggregation. Rankings are by score, then by item, so that ties have an order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.mining import exploded, transactions

NONE, STAT_CORR, ODDS_RATIO, RELIEF, RELIEF2 = "none", "stat_corr", "odds_ratio", "relief", "relief2"
#: Hex digits of the hash by which distinct rows are dealt to parts for a sample of rows.
PART_DIGITS = 3


@dataclass(frozen=True)
class SelectionParameters:
    method: str = NONE
    share: float = 0.5  #: of the items, how many the ranking methods select
    threshold: float = 0.9  #: correlation above which the later of two items goes
    sample: int = 100  #: rows that Relief looks at
    seed: int = 42

    def __post_init__(self) -> None:
        if self.method not in (NONE, STAT_CORR, ODDS_RATIO, RELIEF, RELIEF2):
            raise ValueError(f"no selection method {self.method}")
        if not 0 <= self.share <= 1:
            raise ValueError("share must be between 0 and 1")
        if not -1 <= self.threshold <= 1:
            raise ValueError("threshold must be between -1 and 1")
        if self.sample < 1:
            raise ValueError("sample must be 1 or more")


def _counts(rows: DataFrame, target: str) -> DataFrame:
    """(item, n1, n0) with the totals all1 and all0 of rows with and without the target."""
    has = F.array_contains("items", target)
    totals = rows.agg(F.sum(F.when(has, F.col("weight")).otherwise(0)).alias("all1"), F.sum(F.when(has, 0).otherwise(F.col("weight"))).alias("all0"))
    per_item = (
        exploded(rows.withColumn("t", has), "t", "weight")
        .groupBy("item")
        .agg(F.sum(F.when(F.col("t"), F.col("weight")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("t"), 0).otherwise(F.col("weight"))).alias("n0"))
    )
    return per_item.crossJoin(F.broadcast(totals))  # one row of totals


def odds_ratio(df: DataFrame, attrs: list[str], target: str, weight: str | None = None) -> DataFrame:
    """(item, score): log2 of the odds of the item with the target to those without it, for all other items.

    With e = 1/N^2, odds are e/(1-e) where the item never occurs and (1-e)/e where it always does.
    """
    counts = _counts(transactions(df, attrs, weight), target)
    n = F.col("all1") + F.col("all0")
    e = 1 / (n * n).cast("double")

    def odds(count: Column, total: Column) -> Column:
        p = count / total
        return F.when(count == 0, e / (1 - e)).when(count == total, (1 - e) / e).otherwise(p / (1 - p))

    score = F.log2(odds(F.col("n1"), F.col("all1")) / odds(F.col("n0"), F.col("all0")))
    return counts.filter(F.col("item") != target).select("item", score.alias("score"))


def correlations(df: DataFrame, attrs: list[str], weight: str | None = None) -> DataFrame:
    """(a, b, corr) for items a < b that both vary: Pearson's correlation of their 0/1 columns.

    Pairs of items of one attribute never occur together, so all pairs of items are made; items
    are few against rows.
    """
    rows = transactions(df, attrs, weight)
    total = rows.agg(F.sum("weight").alias("total"))
    single = exploded(rows, "weight").groupBy("item").agg(F.sum("weight").alias("n"))
    items = single.crossJoin(F.broadcast(total)).filter("n < total").withColumn("p", F.col("n") / F.col("total"))
    pairs = exploded(rows, "items", "weight").select("weight", F.col("item").alias("a"), F.explode_outer("items").alias("b")).filter("a < b").groupBy("a", "b").agg(F.sum("weight").alias("n11"))
    a = items.select(F.col("item").alias("a"), F.col("p").alias("pa"), "total")
    b = items.select(F.col("item").alias("b"), F.col("p").alias("pb"))
    both = a.join(b, F.col("a") < F.col("b")).join(pairs, ["a", "b"], "left")
    corr = (F.coalesce("n11", F.lit(0)) / F.col("total") - F.col("pa") * F.col("pb")) / F.sqrt(F.col("pa") * (1 - F.col("pa")) * F.col("pb") * (1 - F.col("pb")))
    return both.select("a", "b", corr.alias("corr"))


def stat_corr(df: DataFrame, attrs: list[str], target: str, threshold: float, weight: str | None = None) -> DataFrame:
    """(item) that stay: of two items correlated above the threshold the later goes, whether or not the earlier stays; the target has no part in it."""
    rows = transactions(df, attrs, weight)
    pairs = _correlated_pairs(rows, threshold) if threshold >= 0 else correlations(df, attrs, weight).filter(F.col("corr") > threshold)
    gone = pairs.filter((F.col("a") != target) & (F.col("b") != target)).select(F.col("b").alias("item")).distinct()
    return exploded(rows).distinct().join(gone, "item", "left_anti")


def _correlated_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, corr) for items a < b that are correlated above a threshold of 0 or more; only pairs of one row that can reach it are made.

    Items that never meet aren't correlated above 0. Of two items, the correlation is largest if the rarer
    one's rows are all the other's; then its square is the quotient of their odds. So the items of
    a row are put in order of their odds, and each is paired with those behind it as long as the quotient is
    over the threshold's square, give or take what rounding may do; the exact correlation decides.
    """
    total = rows.agg(F.sum("weight").alias("total"))
    single = exploded(rows, "weight").groupBy("item").agg(F.sum("weight").alias("n")).crossJoin(F.broadcast(total)).filter("n < total")  # one row of totals
    known = exploded(rows, "items", "weight").join(single, "item")
    # distinct rows have distinct items, so these tell the rows apart
    ordered = known.groupBy("items", "weight", "total").agg(F.expr("sort_array(collect_list(struct(n / (total - n) AS odds, item AS item, n AS n)), false) AS found"))
    made = ordered.selectExpr("weight", "total", "found", "posexplode(found) AS (at, one)")
    made = made.selectExpr("weight", "total", "one", f"explode(filter(slice(found, at + 2, size(found)), x -> x.odds >= {threshold * threshold!r}D * one.odds * (1 - 1e-9D))) AS other")
    pairs = made.selectExpr("weight", "total", "least(one.item, other.item) AS a", "greatest(one.item, other.item) AS b", "least(one.n, other.n) AS low", "greatest(one.n, other.n) AS high")
    n11 = pairs.groupBy("a", "b", "total", "low", "high").agg(F.sum("weight").alias("n11")).withColumns({"pa": F.expr("low / total"), "pb": F.expr("high / total")})
    return n11.selectExpr("a", "b", "(n11 / total - pa * pb) / sqrt(pa * (1 - pa) * pb * (1 - pb)) AS corr").filter(F.col("corr") > threshold)


def relief_sample(df: DataFrame, attrs: list[str], m: int, seed: int, weight: str | None = None) -> DataFrame:
    """(items, times): m of the rows, each as likely as any other; all of them if they are fewer.

    Rows stand in the order of a seeded hash of their items, and every (number of rows / m)-th is
    taken, from the middle of the first step on. Distinct rows are dealt to parts by the hash, whose sizes
    are added up, and rows are added up within their part, so no task orders all of them.
    """
    rows = transactions(df, attrs, weight).withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), "items"))).withColumn("part", F.substring("key", 1, PART_DIGITS))
    sizes = rows.groupBy("part").agg(F.sum("weight").alias("size"))
    every, earlier = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"), F.sum("size").over(whole).alias("total"))  # 4096 rows
    within = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(F.broadcast(starts), "part").withColumn("upto", F.col("start") + F.sum("weight").over(within))
    # how many of the rows (2 i + 1) total / (2 m), cut off, are before a place
    twice = 2 * F.col("total")
    taken = lambda place: (2 * m * place + F.col("total") - 1 - (2 * m * place + F.col("total") - 1) % twice) / twice
    times = F.when(F.col("total") <= m, F.col("weight")).otherwise(taken(F.col("upto")) - taken(F.col("upto") - F.col("weight")))
    return placed.select("items", times.cast("long").alias("times")).filter("times > 0")


def relief(df: DataFrame, attrs: list[str], target: str, m: int, seed: int = 42, second: bool = False, weight: str | None = None) -> DataFrame:
    """(item, score) of all items but the target by the nearest hit and miss of m sampled rows.

    Distance is the number of items, less the target, in which two rows differ; of equally near
    rows the one with the smaller items counts. A sampled row that occurs once is not its own hit.
    Rows without hit or miss add nothing for it. second gives the variant with steps of 2 and
    further losses of 1.
    """
    rows = transactions(df, attrs, weight)
    sampled = relief_sample(df, attrs, m, seed, weight).select(F.col("items").alias("own"), "times")
    # m distinct rows at most meet the distinct rows; what is kept of each is one row
    pairs = rows.crossJoin(F.broadcast(sampled))
    has = lambda c: F.array_contains(c, target)
    apart = F.filter(F.concat(F.array_except("items", "own"), F.array_except("own", "items")), lambda x: x != target)
    pairs = pairs.filter((F.col("items") != F.col("own")) | (F.col("weight") > 1)).withColumn("near", F.struct(F.size(apart).alias("d"), F.col("items").alias("items")))
    hit = has("items") == has("own")
    nearest = pairs.groupBy("own", "times").agg(F.min(F.when(hit, F.col("near"))).alias("hit"), F.min(F.when(~hit, F.col("near"))).alias("miss"))
    every = exploded(rows).filter(F.col("item") != target).distinct()
    cells = nearest.crossJoin(F.broadcast(every))
    own, in_hit, in_miss = (F.coalesce(F.array_contains(c, F.col("item")), F.lit(False)) for c in ("own", "hit.items", "miss.items"))
    step = 2 if second else 1
    sign = F.when(has("own"), 1).otherwise(-1) * F.when(own, 1).otherwise(-1)
    gain = F.when(F.col("hit").isNotNull() & (own == in_hit), step * sign).otherwise(0) + F.when(F.col("miss").isNotNull() & (own != in_miss), step * sign).otherwise(0)
    if second:
        gain = gain - F.when(F.col("miss").isNotNull() & own & in_miss, 1).otherwise(0) - F.when(F.col("hit").isNotNull() & ~has("own") & (own != in_hit), 1).otherwise(0)
    return cells.groupBy("item").agg((F.sum(gain * F.col("times")) / F.sum("times")).alias("score"))


def best_share(scores: DataFrame, share: float, n_items: int) -> DataFrame:
    """(item) with the best scores, as many as share of all items, rounded half up."""
    return scores.orderBy(F.desc("score"), "item").limit(math.floor(n_items * share + 0.5)).select("item")


def select_items(df: DataFrame, attrs: list[str], target: str, p: SelectionParameters, weight: str | None = None) -> DataFrame:
    """(item) selected for a target item, which is always among them."""
    every = exploded(transactions(df, attrs, weight)).distinct()
    if p.method == NONE:
        return every
    if p.method == STAT_CORR:
        chosen = stat_corr(df, attrs, target, p.threshold, weight)
    else:
        if p.method == ODDS_RATIO:
            scores = odds_ratio(df, attrs, target, weight)
        else:
            scores = relief(df, attrs, target, p.sample, p.seed, p.method == RELIEF2, weight)
        chosen = best_share(scores, p.share, every.count())
    return chosen.unionByName(every.filter(F.col("item") == target)).distinct()

