"""Frequent itemsets and association rules, general and towards a class.

A table's distinct combinations of categories are counted first, with map-side combining; all
levels work on these weighted transactions. A level extends each row's frequent sets by its
later frequent items, counts the results with one aggregation, and keeps the frequent ones, so
support counting is never a join of rows with candidates. engine="fpgrowth" mines with Spark
ML's FP-growth instead, which is the better choice for long patterns in wide tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import itemsets
from marlstone.functions.names import column
from marlstone.operators.tables import distinct_rows, fresh, require_discrete


#: The length of itemsets from which on a level is looked at, to stop at an empty one.
LOOK_FROM = 4


@dataclass(frozen=True)
class MiningParameters:
    """Support and confidence that a rule needs, and the items of its body and head together."""

    min_support: float = 0.1
    min_confidence: float = 0.7
    max_rule_length: int = 10
    engine: str = "levels"

    def __post_init__(self) -> None:
        if not 0 < self.min_confidence <= 1:
            raise ValueError("min_confidence must be over 0 and at most 1")
        if not 0 <= self.min_support <= 1:
            raise ValueError("min_support must be between 0 and 1")
        if self.engine not in ("levels", "fpgrowth"):
            raise ValueError("engine is levels or fpgrowth")

    @property
    def length(self) -> int:
        """Pairs are always made; lengths of 1 and less are passed over for the default."""
        return self.max_rule_length if self.max_rule_length > 1 else 10

    def least_rows(self, n: int) -> int:
        """Support as a number of rows: cut off, not rounded, and 1 at least."""
        return max(1, int(self.min_support * n))


def transactions(df: DataFrame, attrs: list[str], weight: str | None = None) -> DataFrame:
    """(items, weight): distinct rows as sorted arrays of items, a missing value giving none; a row counts as often as its weight says, if there is one."""
    require_discrete(df, attrs)
    n = fresh(df, "_n")
    rows = distinct_rows(df, attrs, n) if weight is None else df.filter(column(weight) > 0).groupBy(*map(column, attrs)).agg(F.sum(column(weight)).alias(n))
    return rows.select(itemsets.itemset(*[itemsets.item(a) for a in attrs]).alias("items"), F.col(n).alias("weight"))


def exploded(rows: DataFrame, *more: str) -> DataFrame:
    """(item, more) of every item of the transactions.

    An inner explode would make Spark test every row of the table for an empty set, below the
    count of distinct rows; an outer one and a test of the item leave the table's scan alone.
    """
    return rows.select(F.explode_outer("items").alias("item"), *more).filter(F.col("item").isNotNull())


def item_support(df: DataFrame, attrs: list[str]) -> DataFrame:
    """(item, freq) of every value of the columns."""
    return exploded(transactions(df, attrs), "weight").groupBy("item").agg(F.sum("weight").alias("freq"))


def frequent_itemsets(df: DataFrame, attrs: list[str], p: MiningParameters, keep: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(items, freq) of all itemsets with enough support, of p.length items at most; keep (item) says which items may take part."""
    if p.engine == "fpgrowth" and weight is None:
        return _fpgrowth(df, attrs, p, keep)
    rows = transactions(df, attrs, weight).cache()
    least = p.least_rows(_rows_of(rows.agg(F.sum("weight")).first()[0]))
    if keep is not None:
        long = exploded(rows.withColumn("t", F.monotonically_increasing_id()), "t", "weight")
        rows = long.join(F.broadcast(keep.select("item")), "item", "left_semi").groupBy("t").agg(F.first("weight").alias("weight"), F.array_sort(F.collect_list("item")).alias("items")).drop("t")
    return _levels(rows, ["weight"], F.col("weight") >= least, p, len(attrs)).withColumnRenamed("weight", "freq")


def _levels(rows: DataFrame, sums: list[str], enough: Column, p: MiningParameters, n_attrs: int, cached: list[DataFrame] | None = None) -> DataFrame:
    """(items, sums) of all itemsets whose sums are enough; rows are (items, sums), and enough must hold for a subset of any set that it holds for. cached gets what is persisted."""
    cached = [] if cached is None else cached
    added = [F.sum(x).alias(x) for x in sums]
    # an attribute has no more than 1 / support frequent values, so the frequent items are few whatever the rows
    single = rows.select(F.explode("items").alias("item"), *sums).groupBy("item").agg(*added).filter(enough).cache()
    cached.append(single)
    found = single.select(F.array("item").alias("items"), *sums)
    frequent = single.agg(F.array_sort(F.collect_list("item")).alias("all"))
    state = rows.crossJoin(F.broadcast(frequent)).select(itemsets.intersection(F.col("items"), F.col("all")).alias("row"), *sums)
    state = state.groupBy("row").agg(*added).filter(F.size("row") > 1)
    state = state.select("row", *sums, F.posexplode("row").alias("at", "x")).select("row", *sums, "at", F.array("x").alias("items"))
    for length in range(2, min(p.length, n_attrs) + 1):  # a row has one value of each attribute
        later = F.filter(F.sequence(F.lit(0), F.size("row") - 1), lambda i: i > F.col("at"))
        state = state.select("row", *sums, "items", F.explode(later).alias("at"))
        state = state.select("row", *sums, "at", F.concat("items", F.array(F.get("row", F.col("at")))).alias("items"))
        level = state.groupBy("items").agg(*added).filter(enough).cache()
        cached.append(level)
        if length >= LOOK_FROM and level.isEmpty():
            break
        found = found.unionByName(level)
        state = state.join(level.select("items"), "items", "left_semi")
    return found


def candidates(level: DataFrame, length: int) -> DataFrame:
    """(items) of a length, 2 or more, that can be frequent, given the frequent sets (items) one shorter.

    Two sets that agree in all but their last items, which are of different attributes, make one of them
    together; it is a candidate if all its other subsets are frequent as well.
    """
    last, prefix = F.element_at("items", -1), F.slice("items", 1, length - 2)
    a = level.select(prefix.alias("prefix"), last.alias("a"))
    b = level.select(prefix.alias("prefix"), last.alias("b"))
    joined = a.join(b, "prefix").filter((F.col("a") < F.col("b")) & (itemsets.item_attribute(F.col("a")) != itemsets.item_attribute(F.col("b"))))
    made = joined.select(F.concat("prefix", F.array("a", "b")).alias("items"))
    if length < 3:
        return made
    each = made.select("items", F.explode(F.slice("items", 1, length - 2)).alias("less"))  # without one of the last two it is frequent already
    parts = each.select(F.col("items").alias("whole"), itemsets.without_item(F.col("items"), F.col("less")).alias("items"))
    kept = parts.join(level, "items", "left_semi").groupBy("whole").agg(F.count("*").alias("n")).filter(F.col("n") == length - 2)
    return kept.select(F.col("whole").alias("items"))


def _rows_of(n: int | None) -> int:
    if not n:
        raise ValueError("no rows to mine")
    return int(n)


def _fpgrowth(df: DataFrame, attrs: list[str], p: MiningParameters, keep: DataFrame | None) -> DataFrame:
    from pyspark.ml.fpm import FPGrowth

    require_discrete(df, attrs)
    n = _rows_of(df.count())
    rows = df.select(itemsets.itemset(*[itemsets.item(a) for a in attrs]).alias("items")).filter(F.size("items") > 0)
    # FP-growth rounds the least number of rows up; it is cut off here
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, p.least_rows(n) / n - 1e-12), minConfidence=1.0).fit(rows)
    found = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq").filter(F.size("items") <= p.length)
    if keep is None:
        return found
    kept = F.broadcast(keep.agg(F.collect_set("item").alias("keep")))
    return found.crossJoin(kept).filter(itemsets.is_subset(F.col("items"), F.col("keep"))).drop("keep")


def _split_heads(found: DataFrame) -> DataFrame:
    """(body, head, pos): every itemset of two items or more with each of its items as head."""
    return found.filter(F.size("items") > 1).select("items", F.col("freq").alias("pos"), F.explode("items").alias("head")).select(
        itemsets.without_item(F.col("items"), F.col("head")).alias("body"), "head", "pos"
    )


def _with_confidence(split: DataFrame, found: DataFrame, least: float, *by: str) -> DataFrame:
    bodies = found.select(*by, F.col("items").alias("body"), "freq")
    return split.join(bodies, [*by, "body"]).withColumn("neg", F.col("freq") - F.col("pos")).withColumn("conf", F.col("pos") / F.col("freq")).filter(F.col("conf") >= least)


def association_rules(df: DataFrame, attrs: list[str], p: MiningParameters) -> DataFrame:
    """(body, head, pos, neg, freq, conf): all rules with one item as head, enough support of body and head together, and enough confidence."""
    found = frequent_itemsets(df, attrs, p)
    return _with_confidence(_split_heads(found), found, p.min_confidence).select("body", "head", "pos", "neg", "freq", "conf")


def class_rules(df: DataFrame, attrs: list[str], class_: str, p: MiningParameters, selected: dict[str, DataFrame] | None = None, weight: str | None = None) -> DataFrame:
    """Rules towards every value of the class with minimal bodies: none holds the body of another confident rule for that value.

    selected gives, for a class item, the items (item) that may take part for it; the class item
    itself always may. Supports are counted over all rows, whatever is selected.
    """
    require_discrete(df, [class_])
    attrs = [a for a in attrs if a != class_]
    known = df.filter(column(class_).isNotNull())
    found = frequent_itemsets(known, [*attrs, class_], p, weight=weight)
    return _class_rules(found, class_, p, selected)


def class_rules_of_folds(rows: DataFrame, attrs: list[str], class_: str, p: MiningParameters, weights: list[str], total: str, cached: list[DataFrame] | None = None) -> DataFrame:
    """(fold, body, head, pos, neg, freq, conf): for each fold the minimal class rules of the rows that aren't in it.

    rows are weighted: total of them, weights[i] in fold i. Counts add up over folds, so itemsets of all folds
    are counted together, those for learning being the total less the fold's own; a set is
    followed up as long as it is frequent for one fold. The number of jobs doesn't depend on the folds.
    """
    attrs = [a for a in attrs if a != class_]
    require_discrete(rows, [*attrs, class_])
    names = [f"t{i}" for i in range(len(weights))]
    items = itemsets.itemset(*[itemsets.item(a) for a in (*attrs, class_)]).alias("items")
    learnt = rows.filter(column(class_).isNotNull()).select(items, *[(column(total) - column(w)).alias(t) for w, t in zip(weights, names)])
    learnt = learnt.groupBy("items").agg(*[F.sum(t).alias(t) for t in names]).cache()
    sizes = learnt.agg(*[F.sum(t).alias(t) for t in names]).first()
    least = [p.least_rows(sizes[t] or 0) for t in names]
    enough = reduce(lambda a, b: a | b, [F.col(t) >= n for t, n in zip(names, least)])
    found = _levels(learnt, names, enough, p, len(attrs) + 1, cached)
    if cached is not None:
        cached.append(learnt)
    by_fold = found.select("items", F.posexplode(F.array(*names)).alias("fold", "freq")).filter(F.col("freq") >= F.get(F.lit(least), F.col("fold")))
    return _class_rules(by_fold, class_, p, None, "fold", cached=cached)


def _class_rules(found: DataFrame, class_: str, p: MiningParameters, selected: dict[str, DataFrame] | None, *by: str, cached: list[DataFrame] | None = None) -> DataFrame:
    """Minimal class rules from frequent sets, apart for each value of by."""
    is_class = lambda x: itemsets.item_attribute(x) == itemsets.item_name(class_)
    with_class = found.filter(F.exists("items", is_class) & (F.size("items") > 1))
    split = with_class.select(
        *by, F.filter("items", lambda x: ~is_class(x)).alias("body"), F.element_at(F.filter("items", is_class), 1).alias("head"), F.col("freq").alias("pos")
    )
    bodies = found.filter(~F.exists("items", is_class))
    rules = _with_confidence(split, bodies, p.min_confidence, *by)
    if selected is not None:
        allowed = None
        for head, items in selected.items():
            one = items.select(F.lit(head).alias("head"), "item")
            allowed = one if allowed is None else allowed.unionByName(one)
        if allowed is not None:
            sets = allowed.groupBy("head").agg(F.collect_set("item").alias("keep"))
            rules = rules.join(sets, "head", "left").filter(F.col("keep").isNull() | itemsets.is_subset(F.col("body"), F.col("keep"))).drop("keep")
    rules = rules.cache()
    if cached is not None:
        cached.append(rules)
    smaller = rules.select(*by, "head", "body", F.explode(itemsets.proper_subsets(F.col("body"))).alias("part"))
    covered = smaller.join(rules.select(*by, "head", F.col("body").alias("part")), [*by, "head", "part"], "left_semi").select(*by, "head", "body").distinct()
    return rules.join(covered, [*by, "head", "body"], "left_anti").select(*by, "body", "head", "pos", "neg", "freq", "conf")


def candidate_counts(df: DataFrame, attrs: list[str], p: MiningParameters) -> DataFrame:
    """(length, candidates, itemsets): how many sets of each length can be frequent, as all of their subsets are, and how many of them are; up to the first length without candidates.

    Mining itself extends sets within rows, so it only counts sets that occur and whose beginnings are frequent; to look up all other subsets as well takes
    longer than to count these.
    """
    found = frequent_itemsets(df, attrs, p).select("items").cache()
    every = item_support(df, attrs).agg(F.count("*").alias("candidates")).select(F.lit(1).alias("length"), "candidates")
    for length in range(2, min(p.length, len(attrs)) + 1):
        shorter = found.filter(F.size("items") == length - 1)
        every = every.unionByName(candidates(shorter, length).agg(F.count("*").alias("candidates")).select(F.lit(length).alias("length"), "candidates"))
    frequent = found.groupBy(F.size("items").alias("length")).agg(F.count("*").alias("itemsets"))
    out = every.filter("candidates > 0").join(frequent, "length", "left")
    return out.select("length", "candidates", F.coalesce("itemsets", F.lit(0)).alias("itemsets"))
