"""Cross-validation of mined classifiers: exact folds, one fold, ten folds, and the grid of strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.itemsets import item_name
from marlstone.functions.names import column
from marlstone.operators.classify import MAX_COVER, N_ALL, N_EACH, ClassifierParameters, accuracies, build_classifier, build_classifiers, class_values, fold_accuracies
from marlstone.operators.mining import MiningParameters, class_rules, class_rules_of_folds
from marlstone.operators.rules import Rule, from_mined
from marlstone.operators.selection import NONE, SelectionParameters, select_items
from marlstone.operators.tables import distinct_rows, fresh

FOLDS = 10
GRID_N = (1, 2, 5, 10, 15, 20)
GRID = [(s, default, n) for s in (N_ALL, N_EACH, MAX_COVER) for default in (True, False) for n in GRID_N]
#: Hex digits of the hash by which rows are dealt out before they are numbered.
_DIGITS = 3


def numbered(df: DataFrame, *key: str, seed: int = 42, name: str = "_number") -> DataFrame:
    """df with consecutive numbers from 0 in a random order that seed and key fix.

    Rows are dealt to 16^_DIGITS parts by hash; the parts' sizes are added up in a small table,
    and rows are numbered within their part, so no task orders all rows. The key should tell rows
    apart; where few keys have many rows, weighted_folds() numbers them without touching a row.
    """
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(column(k).cast("string"), F.lit("?")) for k in key]))
    at, part, start = (fresh(df, x) for x in ("_place", "_part", "_start"))
    rows = df.withColumn(at, place).withColumn(part, F.substring(at, 1, _DIGITS))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(part, F.coalesce(earlier, F.lit(0)).alias(start))  # 4096 rows
    within = F.row_number().over(Window.partitionBy(part).orderBy(at, *key)) - 1
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(start) + within).drop(at, part, start)


def with_folds(df: DataFrame, *key: str, folds: int = FOLDS, seed: int = 42, name: str = "fold") -> DataFrame:
    """df with a random fold from 0; sizes differ by one at most, the first folds being the larger."""
    number = fresh(df, "_number")
    return numbered(df, *key, seed=seed, name=number).withColumn(name, F.pmod(F.col(number), F.lit(folds)).cast("int")).drop(number)


def weighted_folds(df: DataFrame, columns: list[str], *key: str, folds: int = FOLDS, seed: int = 42) -> tuple[DataFrame, list[str], str]:
    """The distinct rows of some columns, how many of each are in every fold, and how many there are: the table and the names of these columns.

    The folds are those of with_folds() under the same key: the n rows of a distinct row take the
    places from s to s + n of the random order, and how many of these fall to a fold is arithmetic.
    So only distinct rows are ordered, within parts by hash, and one with half of all rows is one row.
    """
    wanted = list(dict.fromkeys([*columns, *key]))
    n, part, at, start, earlier = (fresh(df, x) for x in ("_n", "_part", "_at", "_start", "_earlier"))
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(column(k).cast("string"), F.lit("?")) for k in key]))
    rows = distinct_rows(df, wanted, n).withColumn(at, place).withColumn(part, F.substring(at, 1, _DIGITS))
    before = Window.unboundedPreceding, -1
    sizes = rows.groupBy(part).agg(F.sum(n).alias("m"))
    starts = sizes.select(part, F.coalesce(F.sum("m").over(Window.orderBy(part).rowsBetween(*before)), F.lit(0)).alias(start))  # 4096 rows
    within = Window.partitionBy(part).orderBy(at, *map(column, wanted)).rowsBetween(*before)
    rows = rows.join(F.broadcast(starts), part).withColumn(earlier, F.col(start) + F.coalesce(F.sum(n).over(within), F.lit(0)))
    weights = [fresh(df, f"_w{i}") for i in range(folds)]
    upto = lambda x, i: f"({x} + {folds - 1 - i}) div {folds}"  # noqa: E731  how many places below x are fold i's
    placed = rows.select(*map(column, columns), n, *[F.expr(f"{upto(f'({earlier} + {n})', i)} - {upto(earlier, i)}").alias(w) for i, w in enumerate(weights)])
    return placed.groupBy(*map(column, columns)).agg(*[F.sum(x).alias(x) for x in (*weights, n)]), weights, n


def mine_rules(df: DataFrame, attrs: list[str], class_: str, p: MiningParameters, s: SelectionParameters = SelectionParameters(), weight: str | None = None) -> list[Rule]:
    """Class rules as a list, best first, with each class value's own selection of items."""
    others = [a for a in attrs if a != class_]
    selected = None
    if s.method != NONE:
        known = df.filter(column(class_).isNotNull())
        heads = [f"{item_name(class_)}={v}" for v in class_values(df, class_)]
        selected = {h: select_items(known, [*others, class_], h, s, weight) for h in heads}
    return from_mined(class_rules(df, others, class_, p, selected, weight).collect())


def run_classifier(df: DataFrame, attrs: list[str], class_: str, p: MiningParameters, c: ClassifierParameters, s: SelectionParameters = SelectionParameters()) -> list[Rule]:
    """Mining, selection and construction in one."""
    return build_classifier(df, mine_rules(df, attrs, class_, p, s), class_, c)


def _by_fold(df: DataFrame, attrs: list[str], class_: str, p: MiningParameters, many: list[ClassifierParameters], s: SelectionParameters, key: tuple[str, ...], folds: int, seed: int) -> list[list[float]]:
    """The accuracy on each fold, for each of several parameters, of classifiers made from the other folds.

    All folds are mined, covered and tested together. Only a selection of items is made for each fold from its own rows.
    """
    others = [a for a in attrs if a != class_]
    rows, weights, total = weighted_folds(df.filter(column(class_).isNotNull()), [*others, class_], *(key or df.columns), folds=folds, seed=seed)
    rows = rows.cache()
    lists: list[list[Rule]] = []
    if s.method == NONE:
        found: dict[int, list] = {}
        cached: list[DataFrame] = []
        for r in class_rules_of_folds(rows, others, class_, p, weights, total, cached).collect():
            found.setdefault(r["fold"], []).append(r)
        for x in cached:
            x.unpersist()
        lists = [from_mined(found.get(i, [])) for i in range(folds)]
    else:
        train = fresh(rows, "_train")
        for w in weights:
            learnt = rows.withColumn(train, F.col(total) - F.col(w)).filter(F.col(train) > 0)
            lists.append(mine_rules(learnt, others, class_, p, s, train))
    out = fold_accuracies(rows, lists, class_, many, weights, total)
    rows.unpersist()
    return out


def cross_validate(df: DataFrame, attrs: list[str], class_: str, p: MiningParameters, c: ClassifierParameters, s: SelectionParameters = SelectionParameters(), key: tuple[str, ...] = (), folds: int = FOLDS, seed: int = 42) -> list[float]:
    """The accuracy on each fold of a classifier made from the others; their mean is the result."""
    return [x for [x] in _by_fold(df, attrs, class_, p, [c], s, key, folds, seed)]


def grid(train: DataFrame, test: DataFrame, attrs: list[str], class_: str, p: MiningParameters, s: SelectionParameters = SelectionParameters(), cells: list = GRID) -> list[tuple[str, bool, int, float]]:
    """(strategy, default rule, N, accuracy) of every cell, from one mining of the training rows."""
    rules = mine_rules(train, attrs, class_, p, s)
    made = build_classifiers(train, rules, class_, [ClassifierParameters(k, n, d) for k, d, n in cells])
    return [(*cell, x) for cell, x in zip(cells, accuracies(test, made, class_))]


def grid_folds(df: DataFrame, attrs: list[str], class_: str, p: MiningParameters, s: SelectionParameters = SelectionParameters(), key: tuple[str, ...] = (), folds: int = FOLDS, seed: int = 42, cells: list = GRID) -> list[tuple[int, str, bool, int, float]]:
    """(fold, strategy, default rule, N, accuracy): the grid for every fold."""
    found = _by_fold(df, attrs, class_, p, [ClassifierParameters(k, n, d) for k, d, n in cells], s, key, folds, seed)
    return [(i, *cell, x) for i, one in enumerate(found) for cell, x in zip(cells, one)]
