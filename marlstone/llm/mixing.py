"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Weights sit on the nodes of a domain-language-source tree. The token budget runs down from the
root: a node's budget goes to its children by weight, but to none more than its subtree can
give in MAX_EPOCHS passes; what one can't take goes to its siblings by weight. As a node gets no
more than its subtree can give, shortages are made good among siblings first and pass to the
parent's siblings only when a whole subtree is short. A leaf reads its documents in an order
seeded anew for each epoch: whole epochs first, then a prefix with as many tokens as are left.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, text_of

LEVELS = ("domain", "lang", "source")
MAX_EPOCHS, SEED = 4, 42
#: Of an epoch's order, parts with known token counts, so that only the one in which a prefix ends is sorted.
PARTS_DIGITS = 3
#: Leaves from which on a node's children are shared out by ranges of cap / weight; ranges for each doubling. Both ways give the same budgets.
MANY, RANGES = 200_000, 64


def count_tokens(text: str = "text") -> Column:
    """Words of a text: runs without ASCII white space. Null counts as empty."""
    return F.regexp_count(text_of(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds share: the part of the parent's budget that each child gets by weight, none more than cap.

    Children fill up in the order of cap / weight. The level is what a unit of weight gets; with
    the first ones full it is the rest of the budget by the rest of the weight. It rises while
    children fill up and falls after, so the share is by its maximum.
    """
    none = F.lit(0.0)
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.nullif(F.col("weight"), none), name)
    before, all_ = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), none)) / F.nullif(
        F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), none), none
    )
    return (
        children.withColumn("level", F.when(F.col("weight") > 0, level))
        .withColumn("share", F.when(F.col("weight") > 0, F.least("cap", F.col("weight") * F.max("level").over(all_))).otherwise(none))
        .drop("level")
    )


def share_out_many(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """share_out() where a parent may have any number of children, which should be materialised.

    They are added up by ranges of cap / weight, and only the range in which the level lies is
    gone through child by child.
    """
    none, ratio = F.lit(0.0), F.col("cap") / F.col("weight")
    ranged = children.filter("weight > 0").withColumn("range", F.coalesce(F.floor(F.log2(ratio) * RANGES), F.lit(-(1 << 40))))
    by = Window.partitionBy(*parent)
    earlier = by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(*parent, "range").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w"), F.min(ratio).alias("low"), F.first("budget").alias("whole"))
    ranges = ranges.withColumns({"full": F.coalesce(F.sum("c").over(earlier), none), "open": F.sum("w").over(by) - F.coalesce(F.sum("w").over(earlier), none)})
    reached = F.max(F.when(F.col("full") + F.col("open") * F.col("low") <= F.col("whole"), F.col("range"))).over(by)
    cut = ranges.withColumn("cut", F.coalesce(reached, F.min("range").over(by))).filter("range = cut").select(
        *parent, "range", "full", "open", ((F.col("whole") - F.col("full") - F.col("c")) / F.nullif(F.col("open") - F.col("w"), none)).alias("after")
    )
    before = by.orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.col("full") - F.coalesce(F.sum("cap").over(before), none)) / F.nullif(F.col("open") - F.coalesce(F.sum("weight").over(before), none), none)
    levels = ranged.join(cut, [*parent, "range"]).withColumn("level", level).groupBy(*parent).agg(F.greatest(F.max("level"), F.max("after")).alias("level"))
    share = F.when(F.col("weight") > 0, F.least("cap", F.col("weight") * F.col("level"))).otherwise(none)
    return children.join(levels, parent, "left").withColumn("share", share).drop("level")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, budget_ratio: float, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (LEVELS, tokens) with their budget in tokens.

    weights has LEVELS and weight; a node of the first level is a row whose other levels are
    null, and so on; a node without row has weight 1, a negative or null weight counts as 0. The
    whole budget is budget_ratio times all tokens, and at most what the tree can give.
    """
    nodes = leaves.select(*LEVELS, "tokens").withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    root = "_root"
    nodes = nodes.withColumn(root, F.lit(1))
    for depth in range(len(LEVELS)):
        own, below = LEVELS[: depth + 1], LEVELS[depth + 1 :]
        given = weights.filter(reduce(lambda a, b: a & b, [F.col(x).isNull() for x in below], F.col(own[-1]).isNotNull()))
        given = given.groupBy(*own).agg(F.greatest(F.coalesce(F.max("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"w{depth}"))
        nodes = nodes.join(given, list(own), "left").withColumn(f"w{depth}", F.coalesce(f"w{depth}", F.lit(1.0)))
    dead = reduce(lambda a, b: a | b, [F.col(f"w{d}") <= 0 for d in range(len(LEVELS))])
    nodes = materialise(nodes.withColumn("cap", F.when(dead, 0.0).otherwise(F.col("cap"))), "nodes")
    many = nodes.count() > MANY
    total = nodes.groupBy(root).agg(F.least(F.sum("tokens") * F.lit(float(budget_ratio)), F.sum("cap")).alias("budget"))
    for depth in range(len(LEVELS)):
        own, parent = list(LEVELS[: depth + 1]), [root, *LEVELS[:depth]]
        here = nodes.groupBy(root, *own).agg(F.sum("cap").alias("cap"), F.max(f"w{depth}").alias("weight"))
        here = here.join(total, parent)
        shared = share_out_many(materialise(here, "children"), parent, own[-1]) if many else share_out(here, parent, own[-1])
        total = shared.select(root, *own, F.col("share").alias("budget"))
    return total.select(*LEVELS, F.floor(F.col("budget") + 1e-6).alias("budget"))


def _place(epoch: Column, seed: int, doc_id: str = "doc_id", text_md5: Column | str = "text_md5") -> Column:
    """A row's place in an epoch's order, by its id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text_md5))


def mixing_plan(rows: DataFrame, weights: DataFrame, budget_ratio: float, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per leaf of rows (doc_id, text_md5, LEVELS, n_tokens): epochs (whole passes) and last_place (the last place of the next pass that is still taken, or null)."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = leaf_budgets(leaves, weights, budget_ratio, max_epochs).join(leaves, list(LEVELS))
    epochs = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.when(F.col("epochs") < max_epochs, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("long")
    )
    plan = materialise(plan, "plan")
    placed = rows.join(plan.filter("rest > 0").select(*LEVELS, "epochs", "rest"), list(LEVELS)).select(
        *LEVELS, "rest", "n_tokens", _place(F.col("epochs"), seed).alias("place")
    )
    placed = placed.withColumn("part", F.substring("place", 1, PARTS_DIGITS))
    parts = placed.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("sum"), F.max("place").alias("last"), F.first("rest").alias("rest"))
    parts = parts.withColumn("upto", F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("part")))
    whole = parts.filter("upto <= rest").select(*LEVELS, F.col("last").alias("place"))
    cut = parts.filter("upto > rest and upto - sum < rest").select(*LEVELS, "part", (F.col("upto") - F.col("sum")).alias("before"))
    # equal rows share a place, and any number of them are one row here
    inside = placed.join(cut, [*LEVELS, "part"]).groupBy(*LEVELS, "part", "place", "rest", "before").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "part").orderBy("place")))
    last = whole.unionByName(inside.filter("upto <= rest").select(*LEVELS, "place")).groupBy(*LEVELS).agg(F.max("place").alias("last_place"))
    return plan.join(last, list(LEVELS), "left").select(*LEVELS, "budget", "epochs", "last_place")


def mix(docs: DataFrame, weights: DataFrame, domain: Column, budget_ratio: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with added columns mix_domain, mix_tokens and mix_copies: how often a document is taken, 0 for not at all.

    docs has doc_id, text, lang, source; domain says which domain a row is of. Null languages,
    sources and domains are the leaf ''. Null text has no tokens, and such a document is taken as
    often as its place says. A place follows from id and text, so rows equal in both are all taken
    or all left, and rows without id or under a repeated one have places of their own. An empty
    table gives no rows. Other columns are kept, whatever their names,
    but those three are replaced. Only leaf totals and the parts of a leaf's order are shuffled;
    the plan has one row per leaf and is joined by Spark's own choice.
    """
    keyed = docs.withColumns({"mix_domain": F.coalesce(domain, F.lit("")), "mix_tokens": count_tokens()})
    leaf = {"domain": F.col("mix_domain"), "lang": F.coalesce(F.col("lang"), F.lit("")), "source": F.coalesce(F.col("source"), F.lit(""))}
    text_md5 = F.md5(text_of().cast("binary"))
    rows = materialise(keyed.select("doc_id", text_md5.alias("text_md5"), *[v.alias(k) for k, v in leaf.items()], F.col("mix_tokens").alias("n_tokens")), "tokens")
    plan = mixing_plan(rows, weights, budget_ratio, max_epochs, seed)
    own = {x: f"_mix_{uuid.uuid4().hex}_{x}" for x in plan.columns}  # no column of docs can have such a name
    plan = materialise(plan.select(*[F.col(x).alias(y) for x, y in own.items()]), "mix")
    taken = F.when(_place(F.col(own["epochs"]), seed, text_md5=text_md5) <= F.col(own["last_place"]), 1).otherwise(0)
    joined = keyed.join(plan, reduce(lambda a, b: a & b, [leaf[x] == F.col(own[x]) for x in LEVELS]))
    return joined.withColumn("mix_copies", (F.col(own["epochs"]) + taken).cast("long")).drop(*own.values())
