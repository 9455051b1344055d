"""Rule lists as classifiers: construction by greedy covering, evaluation and labelling.

Construction needs to know only which rules cover a row, and its class. Rows are reduced once to
the distinct combinations of these with their number. If that table is small, by count, the
greedy steps are taken on the driver, where each row of it is taken out of all rules' counts
once; else every step is one aggregation over it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.names import column
from marlstone.operators.matching import LONG_LIST, with_first_head, with_places
from marlstone.operators.rules import EQ, Literal, Rule, check, order_key
from marlstone.operators.tables import fresh

USE_ALL, N_ALL, N_EACH, MAX_COVER = "all", "n_all", "n_each", "max_cover"
#: Distinct signatures times rules up to which greedy steps are taken on the driver, without a job for each.
LOCAL_CELLS = 20_000_000


@dataclass(frozen=True)
class ClassifierParameters:
    strategy: str = USE_ALL
    n_rules: int = 10
    default_rule: bool = True
    reference_order: bool = False  #: n_each: worst rule first, as a reader of old results may want

    def __post_init__(self) -> None:
        if self.strategy not in (USE_ALL, N_ALL, N_EACH, MAX_COVER):
            raise ValueError(f"no strategy {self.strategy}")
        if self.strategy != USE_ALL and self.n_rules < 1:
            raise ValueError("n_rules must be 1 or more")


class _Signatures:
    """Which rules cover a row, its class, and how many such rows there are: a number for each of weights."""

    def __init__(self, df: DataFrame, rules: list[Rule], class_: str, *weights: str):
        self.rules, self.class_, self.weights = rules, class_, [f"n{i}" for i in range(max(1, len(weights)))]
        known = df.filter(column(class_).isNotNull())
        ws = [column(w).cast("long") for w in weights] or [F.lit(1).cast("long")]
        cover = fresh(df, "_cover")
        rows = with_places(known, rules, cover).select(F.col(cover).alias("cover"), column(class_).cast("string").alias("class"), *[w.alias(n) for w, n in zip(ws, self.weights)])
        self.rows = rows.groupBy("cover", "class").agg(*[F.sum(n).alias(n) for n in self.weights]).cache()
        self.here: Held | None = None
        if self.rows.count() * max(1, len(rules)) <= LOCAL_CELLS:
            found = self.rows.toArrow()
            places = found["cover"].combine_chunks()
            met = np.zeros((len(rules), found.num_rows), bool)
            met[places.flatten().to_numpy(), np.repeat(np.arange(found.num_rows), np.diff(places.offsets.to_numpy()))] = True
            n = np.array([found[x].to_numpy() for x in self.weights], "i8").reshape(len(self.weights), found.num_rows)
            self.here = Held(met, found["class"].to_pylist(), n, [r.head.value for r in rules])

    def open_rows(self, picked: list[int]) -> Column:
        """Rows that no picked rule covers; one term however many are picked."""
        return ~F.arrays_overlap("cover", F.lit(picked)) if picked else F.lit(True)

    def counts(self, picked: list[int], left: list[int]) -> dict[int, tuple[int, int]]:
        """Positives and negatives of the rules left, on rows that no picked one covers; one job."""
        if not left:
            return {}
        heads = F.lit([r.head.value for r in self.rules])
        rule = F.explode(F.array_intersect("cover", F.lit(left)))
        hits = self.rows.filter(self.open_rows(picked)).select(rule.alias("rule"), "class", F.col(self.weights[0]).alias("n"))
        right = F.get(heads, F.col("rule")) == F.col("class")
        found = hits.groupBy("rule").agg(F.sum(F.when(right, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(right, 0).otherwise(F.col("n"))).alias("m"))
        return {i: (0, 0) for i in left} | {r["rule"]: (r["p"], r["m"]) for r in found.collect()}

    def majority(self, picked: list[int], domain: list[str]) -> str:
        """The most frequent class of rows that no picked rule covers; the first by name of equals, or of all if no row is left."""
        if self.here is not None:
            return self.here.majority(picked, domain, 0)
        top = self.rows.filter(self.open_rows(picked)).groupBy("class").agg(F.sum(self.weights[0]).alias("n")).orderBy(F.desc("n"), "class").first()
        return top["class"] if top else domain[0]


class Held:
    """Signatures on the driver: met says which rows each rule covers, n their numbers under each weight."""

    def __init__(self, met: np.ndarray, classes: list[str], n: np.ndarray, heads: list[str]):
        self.met, self.n = met, n
        self.names = sorted({*classes, *heads})
        code = {c: i for i, c in enumerate(self.names)}
        self.classes, self.heads = np.array([code[c] for c in classes], "i4"), np.array([code[h] for h in heads], "i4")

    def picks(self, candidates: list[int], most: int | None, whole: bool, weight: int | np.ndarray = 0) -> list[tuple[int, int, int]]:
        """(rule, positives, negatives) of the best candidate on the rows not yet covered, again and again: most positives (or most rows, if whole), then fewest negatives, then first.

        Counts are kept, not made anew: a row is taken out of all of them once, when the first rule
        that covers it is picked, so all steps together look at each cell of the table once.
        """
        n = self.n[weight] if np.isscalar(weight) else weight
        rules = np.array(candidates, "i8")
        heads, open_, left = self.heads[rules], n > 0, np.ones(len(rules), bool)
        pos, neg = np.zeros(len(rules), "i8"), np.zeros(len(rules), "i8")

        def add(rows: np.ndarray, sign: int) -> None:
            for a in range(0, len(rules), 256):
                met = self.met[np.ix_(rules[a : a + 256], rows)]
                right = heads[a : a + 256, None] == self.classes[rows]
                pos[a : a + 256] += sign * ((met & right) @ n[rows])
                neg[a : a + 256] += sign * ((met & ~right) @ n[rows])

        add(np.flatnonzero(open_), 1)
        out = []
        while left.any() and (most is None or len(out) < most):
            first = pos + neg if whole else pos
            of_best = left & (first == first[left].max())
            if not whole:
                of_best &= neg == neg[of_best].min()
            best = int(of_best.argmax())
            out.append((int(rules[best]), int(pos[best]), int(neg[best])))
            left[best] = False
            rows = np.flatnonzero(self.met[rules[best]] & open_)
            if rows.size:
                open_[rows] = False
                add(rows, -1)
        return out

    def majority(self, picked: list[int], domain: list[str], weight: int | np.ndarray) -> str:
        n = self.n[weight] if np.isscalar(weight) else weight
        open_ = (n > 0) & ~self.met[picked].any(0)
        totals = np.bincount(self.classes[open_], weights=n[open_], minlength=len(self.names))
        return self.names[int(totals.argmax())] if open_.any() else domain[0]

    def domain(self, n: np.ndarray) -> list[str]:
        """The classes that rows have."""
        return [self.names[c] for c in np.unique(self.classes[n > 0])]

    def right(self, places: list[int], otherwise: str | None, n: np.ndarray) -> float:
        """The share of rows whose class is the head of the first rule of a list that covers them, or else a default; 0 for no rows."""
        met = self.met[places]
        first = met.argmax(0) if places else np.zeros(len(n), "i8")
        said = np.where(met.any(0), self.heads[np.array(places, "i8")][first], -1) if places else np.full(len(n), -1)
        if otherwise is not None:
            said = np.where(said < 0, self.names.index(otherwise), said)
        return float(n[said == self.classes].sum() / n.sum()) if n.sum() else 0.0


def class_values(df: DataFrame, class_: str) -> list[str]:
    return [r[0] for r in df.select(column(class_).cast("string").alias("c")).filter("c is not null").distinct().orderBy("c").collect()]


def most_frequent_class(df: DataFrame, class_: str) -> DataFrame:
    """(class, n): the most frequent class, the first by name of equals."""
    return df.filter(column(class_).isNotNull()).groupBy(column(class_).alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(1)


def _picked(s: _Signatures, candidates: list[int], most: int | None, whole: bool, weight: int | np.ndarray = 0) -> list[tuple[int, int, int]]:
    """Held.picks(), on the driver or with a job for each pick."""
    if s.here is not None:
        return s.here.picks(candidates, most, whole, weight)
    out, left = [], list(candidates)
    while left and (most is None or len(out) < most):
        counts = s.counts([i for i, _, _ in out], left)
        first = (lambda i: -sum(counts[i])) if whole else (lambda i: -counts[i][0])
        best = min(left, key=lambda i: (first(i), 0 if whole else counts[i][1], left.index(i)))
        out.append((best, *counts[best]))
        left.remove(best)
    return out


def _ordered(s: _Signatures, rules: list[int], domain: list[str], strategy: str, n: int | None, weight: int | np.ndarray = 0) -> list[list[tuple[int, Rule]]]:
    """The picks of a strategy among some of the rules, in one list or in one for each class; the picks for fewer rules are the first of each list."""
    groups = [[i for i in rules if s.rules[i].head.value == c] for c in domain] if strategy == N_EACH else [rules]
    if strategy == MAX_COVER:  # the class is ignored, and counts stay those of mining
        return [[(i, s.rules[i]) for i, _, _ in _picked(s, rules, n, True, weight)]]
    return [[(i, s.rules[i].counted(p, m)) for i, p, m in _picked(s, g, n, False, weight)] for g in groups]


def _chosen(picks: list[list[tuple[int, Rule]]], p: ClassifierParameters) -> list[tuple[int, Rule]]:
    n = None if p.strategy == USE_ALL else p.n_rules
    chosen = [x for one in picks for x in one[:n]]
    if p.strategy == N_EACH:
        chosen.sort(key=lambda x: order_key(x[1]), reverse=p.reference_order)
    return chosen


def _has_default(p: ClassifierParameters, domain: list[str]) -> bool:
    return p.default_rule and p.strategy != MAX_COVER and bool(domain)


def build_classifier(df: DataFrame, rules: list[Rule], class_: str, p: ClassifierParameters, weight: str | None = None) -> list[Rule]:
    """An ordered rule list from candidate rules, with counts as they were when each was picked."""
    return build_classifiers(df, rules, class_, [p], weight)[0]


def _most(many: list[ClassifierParameters], strategy: str) -> int | None:
    return None if strategy == USE_ALL else max(p.n_rules for p in many if p.strategy == strategy)


def build_classifiers(df: DataFrame, rules: list[Rule], class_: str, many: list[ClassifierParameters], weight: str | None = None) -> list[list[Rule]]:
    """build_classifier for several parameters; each strategy picks once, for its largest number of rules."""
    check(df, rules, class_)
    s, domain = _Signatures(df, rules, class_, *([weight] if weight else [])), class_values(df, class_)
    picks = {k: _ordered(s, list(range(len(rules))), domain, k, _most(many, k)) for k in {p.strategy for p in many}}
    out = []
    for p in many:
        chosen = _chosen(picks[p.strategy], p)
        made = [r for _, r in chosen]
        if _has_default(p, domain):
            made.append(Rule((), Literal(class_, EQ, s.majority([i for i, _ in chosen], domain))))
        out.append(made)
    s.rows.unpersist()
    return out


def fold_accuracies(df: DataFrame, lists: list[list[Rule]], class_: str, many: list[ClassifierParameters], weights: list[str], total: str) -> list[list[float]]:
    """The accuracy of classifiers on every fold, for each of several parameters: made from a fold's own candidate rules, on the rows that aren't in it.

    df has weighted rows: total of them, weights[i] in fold i. What rules of all folds cover is found once, and
    each fold has its own numbers of the same signatures, so the number of jobs doesn't follow the folds; unless
    the signatures are too many for the driver, when each fold's steps are jobs of their own.
    """
    place: dict[tuple, int] = {}
    rules: list[Rule] = []
    for r in (r for one in lists for r in one):
        if (r.body, r.head) not in place:
            place[r.body, r.head] = len(rules)
            rules.append(r)
    check(df, rules, class_)
    s = _Signatures(df, rules, class_, *weights, total)
    out = []
    for fold, own in enumerate(lists):
        if s.here is None:
            n = fresh(df, "_train")
            train = df.withColumn(n, column(total) - column(weights[fold])).filter(F.col(n) > 0)
            made = build_classifiers(train, own, class_, many, n)
            out.append(accuracies(df, made, class_, weights[fold]))
            continue
        test = s.here.n[fold]
        train = s.here.n[-1] - test
        domain, ids = s.here.domain(train), [place[r.body, r.head] for r in own]
        picks = {k: _ordered(s, ids, domain, k, _most(many, k), train) for k in {p.strategy for p in many}}
        of_fold = []
        for p in many:
            chosen = [i for i, _ in _chosen(picks[p.strategy], p)]
            of_fold.append(s.here.right(chosen, s.here.majority(chosen, domain, train) if _has_default(p, domain) else None, test))
        out.append(of_fold)
    s.rows.unpersist()
    return out


def predicted(rules: list[Rule]) -> Column:
    """The head of the first rule that covers a row; null if none does."""
    if not rules:
        return F.lit(None).cast("string")
    if len(rules) <= LONG_LIST:
        chain = F.when(rules[0].covers(), rules[0].head.value)
        for r in rules[1:]:
            chain = chain.when(r.covers(), r.head.value)
        return chain
    place = F.array_position(F.array(*[r.covers() for r in rules]), True)
    return F.get(F.array(*[F.lit(r.head.value) for r in rules]), F.nullif(place, F.lit(0)).cast("int") - 1)


def label(df: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """df with the predicted class as a new discrete column, missing where no rule fires."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    check(df, rules, need_target=False)
    return _with_predicted(df, rules, name).withMetadata(name, {"kind": "d"})


def _with_predicted(df: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """df with predicted(); a long list is looked up in an index of literals, but for a stream, whose rows can't be reduced to distinct ones."""
    if len(rules) > LONG_LIST and not df.isStreaming:
        return with_first_head(df, rules, name)
    return df.withColumn(name, predicted(rules))


def vote(df: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """df with the share of rules that cover a row as a new number; all rules must be of one class value."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    if len({r.head for r in rules}) != 1:
        raise ValueError("voting needs rules of a single class value")
    check(df, rules, need_target=False)
    votes = reduce(lambda a, b: a + b, [F.when(r.covers(), 1.0).otherwise(0.0) for r in rules])
    return df.withColumn(name, votes / len(rules)).withMetadata(name, {"kind": "c"})


def confusion(df: DataFrame, rules: list[Rule], class_: str) -> DataFrame:
    """(predicted, real, n) of rows with a class; predicted is null where no rule fires."""
    known = df.filter(column(class_).isNotNull())
    said = fresh(df, "_predicted")
    found = _with_predicted(known, rules, said).select(F.col(said).alias("predicted"), column(class_).cast("string").alias("real"))
    return found.groupBy("predicted", "real").agg(F.count("*").alias("n"))


def metrics(confusion_: DataFrame) -> DataFrame:
    """One row: rows, correct, wrong, unclassified (these are wrong too), accuracy; 0 for no rows."""
    right = F.coalesce(F.col("predicted") == F.col("real"), F.lit(False))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    correct = F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)).cast("long")
    missed = F.coalesce(F.sum(F.when(F.col("predicted").isNull(), F.col("n"))), F.lit(0)).cast("long")
    out = confusion_.agg(total.alias("rows"), correct.alias("correct"), (total - correct).alias("wrong"), missed.alias("unclassified"))
    return out.withColumn("accuracy", F.when(F.col("rows") > 0, F.col("correct") / F.col("rows")).otherwise(F.lit(0.0)))


def accuracies(df: DataFrame, many: list[list[Rule]], class_: str, weight: str | None = None) -> list[float]:
    """The accuracy of several classifiers on the rows with a class, in one pass; 0 for no rows."""
    known = df.filter(column(class_).isNotNull())
    w = column(weight) if weight else F.lit(1)
    right = [F.sum(F.when(predicted(r) == column(class_).cast("string"), w).otherwise(0)).alias(f"a{i}") for i, r in enumerate(many)]
    row = known.agg(F.sum(w).alias("n"), *right).first()
    return [row[f"a{i}"] / row["n"] if row["n"] else 0.0 for i in range(len(many))]


@dataclass
class Evaluation:
    """A classifier's results on a table: a full matrix with a last row for the unclassified."""

    values: list[str]
    matrix: list[list[int]]

    @property
    def rows(self) -> int:
        return sum(map(sum, self.matrix))

    @property
    def correct(self) -> int:
        return sum(self.matrix[i][i] for i in range(len(self.values)))

    @property
    def unclassified(self) -> int:
        return sum(self.matrix[-1])

    @property
    def accuracy(self) -> float:
        return self.correct / self.rows if self.rows else 0.0


def evaluate(df: DataFrame, rules: list[Rule], class_: str) -> Evaluation:
    check(df, rules, class_)
    cells = confusion(df, rules, class_).collect()
    values = sorted({r["real"] for r in cells} | {r["predicted"] for r in cells if r["predicted"] is not None})
    matrix = [[0] * len(values) for _ in range(len(values) + 1)]
    for r in cells:
        matrix[len(values) if r["predicted"] is None else values.index(r["predicted"])][values.index(r["real"])] = r["n"]
    return Evaluation(values, matrix)
