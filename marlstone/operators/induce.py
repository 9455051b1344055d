"""Rule induction by sequential covering: rules grown literal by literal to least class entropy, then pruned.

The table is reduced to distinct rows with their numbers. A literal is found set at a time: one
job makes a histogram of (column, value, class) over the rows that the rule covers so far and takes the
best literal of all columns. A rule's first job finds the cuts of all numbers besides, by
running sums over the order of each column's values.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.itemsets import all_of
from marlstone.functions.measures import EMPTY_ENTROPY
from marlstone.functions.names import column
from marlstone.operators.discretise import best_cuts, entropy_of_counts, rows_of, value_ranges
from marlstone.operators.rules import EQ, GT, LE, NEQ, Literal, Rule
from marlstone.operators.tables import CONTINUOUS, DISCRETE, distinct_rows, fresh, kind
from marlstone.sources.files import written

#: Digits to which entropies are equal.
DIGITS = 12
#: Rules after which the rows still open are written down, so that no plan grows with the number of rules.
REWRITE = 8
#: Classes up to which pruning bounds entropies from below; the bound looks at all of their subsets.
BOUNDED_CLASSES = 8


@dataclass(frozen=True)
class InductionParameters:
    min_support: int = 10
    use_negation: bool = False
    max_body: int | None = None  #: literals of a body, if they are to be bounded

    def __post_init__(self) -> None:
        if self.min_support < 1:
            raise ValueError("min_support must be 1 or more")
        if self.max_body is not None and self.max_body < 1:
            raise ValueError("max_body must be 1 or more")


def entropy_of(counts: dict[str, int]) -> float:
    n = sum(counts.values())
    return round(-sum(x / n * math.log2(x / n) for x in counts.values() if x), DIGITS) if n else EMPTY_ENTROPY


def majority(counts: dict[str, int]) -> str | None:
    return min(counts, key=lambda c: (-counts[c], c), default=None)


def _class_counts(rows: DataFrame, class_: str, weight: str) -> dict[str, int]:
    return {r[0]: r[1] for r in rows.groupBy(column(class_)).agg(F.sum(column(weight))).collect()}


def candidate_literals(rows: DataFrame, attrs: list[str], class_: str, cuts: dict[str, float], use_negation: bool, weight: str = "_n") -> DataFrame:
    """(place, value, negated, n, entropy, counts) of every literal over weighted rows: all values of discrete columns, both sides of each number's cut.

    One aggregation for all candidates: a negated literal's counts are the total less the
    value's, and missing values, which meet negations only, are in the total.
    """
    pairs = []
    for i, a in enumerate(attrs):
        if a in cuts:
            value = F.when(column(a) <= cuts[a], "0").when(column(a) > cuts[a], "1")
        else:
            value = column(a).cast("string")
        pairs.append(F.struct(F.lit(i).alias("place"), value.alias("value")))
    long = rows.select(column(class_).alias("class"), column(weight).alias("w"), F.explode(F.array(*pairs)).alias("p")).select("class", "w", "p.*")
    counts = long.filter("value is not null").groupBy("place", "value", "class").agg(F.sum("w").alias("n"))
    numbers = [i for i, a in enumerate(attrs) if a in cuts]
    counts = counts.withColumn("negated", (F.col("value") == "1") if numbers and len(numbers) == len(attrs) else F.col("place").isin(numbers) & (F.col("value") == "1"))
    if use_negation:
        total = rows.groupBy(column(class_).alias("class")).agg(F.sum(column(weight)).alias("t"))
        shown = counts.filter(~F.col("place").isin(numbers)) if numbers else counts
        each = shown.select("place", "value").distinct().join(F.broadcast(total), how="cross")  # classes are few
        other = each.join(shown.drop("negated"), ["place", "value", "class"], "left").select("place", "value", "class", (F.col("t") - F.coalesce("n", F.lit(0))).alias("n"), F.lit(True).alias("negated"))
        counts = counts.unionByName(other.filter("n > 0"))
    grouped = counts.groupBy("place", "value", "negated").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"), F.collect_list(F.struct("class", "n")).alias("counts"))
    return grouped.select("place", "value", "negated", "counts", F.col("N").alias("n"), F.round(F.log2(F.col("N").cast("double")) - F.col("s") / F.col("N"), DIGITS).alias("entropy"))


def _literal(attrs: list[str], cuts: dict[str, float], place: int, value: str, negated: bool) -> Literal:
    a = attrs[place]
    if a in cuts:
        return Literal(a, GT if negated else LE, cuts[a])
    return Literal(a, NEQ if negated else EQ, value)


def grow_rules(df: DataFrame, class_: str, p: InductionParameters = InductionParameters(), attrs: list[str] | None = None, max_rules: int | None = None) -> list[Rule]:
    """A rule list for the class: for the most frequent class of what is left, literals of least entropy until no negative is left, no literal
    helps, or fewer than two columns are unused; then the subset of the body with the least entropy, if that is less.

    Rows without class are left out. A discrete column is used once in a rule, a number may be
    used again. Rows that the final rule covers are removed; growing ends when no row is left or
    a rule has no positive. Counts are those on the rows left when the rule was made.
    """
    if kind(df, class_) != DISCRETE:
        raise ValueError("the target must be discrete")
    attrs = attrs if attrs is not None else [x for x in df.columns if x != class_]
    weight = fresh(df, "_n")
    rows = distinct_rows(df.filter(column(class_).isNotNull()), [*attrs, class_], weight).cache()
    open_rows, rules = rows, []
    counts = _class_counts(rows, class_, weight)
    classes = sorted(counts)
    numbers = [a for a in attrs if kind(df, a) == CONTINUOUS]
    ranges = value_ranges(rows, numbers) if numbers else []
    while sum(counts.values()) and (max_rules is None or len(rules) < max_rules):
        body = _grow_body(open_rows, attrs, numbers, class_, classes, counts, p, weight, ranges)
        rule, covered = _prune(open_rows, body, class_, weight)
        if not rule.pos:
            break
        rules.append(rule)
        open_rows = open_rows.filter(~rule.covers())
        if len(rules) % REWRITE == 0:
            open_rows = written(open_rows, "open")
        counts = {c: n - covered[c] for c, n in counts.items()}
    rows.unpersist()
    return rules


def _best(found: DataFrame, p: InductionParameters) -> DataFrame:
    """The best literal: least entropy, then most rows, then first by place and value; the same order as _better()."""
    return found.filter(F.col("n") >= p.min_support).orderBy("entropy", F.desc("n"), "place", "value", "negated").limit(1)


def _first_literal(rows: DataFrame, attrs: list[str], numbers: list[str], class_: str, classes: list[str], p: InductionParameters, weight: str, ranges: list) -> tuple[dict[str, float], list]:
    """The cuts of all numbers on the open rows, and the candidates for the first literal, from one job: the best value, and both sides of each cut."""
    discrete = [a for a in attrs if a not in numbers]
    parts = []
    if numbers:
        sides = best_cuts(rows, numbers, class_, weight, classes, ranges).selectExpr("attr", "cut", "inline(array(struct('0' AS value, below AS sums), struct('1' AS value, above AS sums)))")
        named = sides.withColumn("classes", F.lit(classes) if classes else F.array().cast("array<string>"))
        by_class = "filter(zip_with(classes, sums, (c, x) -> struct(c AS class, x AS n)), x -> x.n > 0) AS counts"
        parts.append(named.selectExpr("attr", "cut", "value", "value = '1' AS negated", by_class, f"{rows_of('sums')} AS n", f"round({entropy_of_counts('sums')}, {DIGITS}) AS entropy"))
    if discrete:
        best = _best(candidate_literals(rows, discrete, class_, {}, p.use_negation, weight), p)
        parts.append(best.select(F.get(F.lit(discrete), F.col("place")).alias("attr"), F.expr("cast(NULL AS double) AS cut"), "value", "negated", "counts", "n", "entropy"))
    found = parts[0].unionByName(parts[1]).collect() if len(parts) > 1 else parts[0].collect() if parts else []
    return {r["attr"]: r["cut"] for r in found if r["cut"] is not None}, [r for r in found if r["n"] >= p.min_support]


def _grow_body(open_rows: DataFrame, attrs: list[str], numbers: list[str], class_: str, classes: list[str], counts: dict[str, int], p: InductionParameters, weight: str, ranges: list) -> list[Literal]:
    body: list[Literal] = []
    current, n = entropy_of(counts), sum(counts.values())
    if n == max(counts.values()) or not attrs:
        return body
    cuts, found = _first_literal(open_rows, attrs, numbers, class_, classes, p, weight, ranges)
    unused = [a for a in attrs if a not in numbers or a in cuts]
    best = min(found, key=lambda r: (r["entropy"], -r["n"], unused.index(r["attr"]), r["value"], r["negated"]), default=None)
    here = open_rows
    while best is not None and (best["entropy"] < current or best["entropy"] == current and best["n"] > n):
        place = unused.index(best["attr"]) if not body else best["place"]
        chosen = _literal(unused, cuts, place, best["value"], best["negated"])
        body.append(chosen)
        here = here.filter(chosen.column())
        if chosen.kind == DISCRETE:
            unused.remove(chosen.attr)
        current, n = best["entropy"], best["n"]
        if n == max(r["n"] for r in best["counts"]) or len(unused) < 2 or p.max_body is not None and len(body) >= p.max_body:
            break
        best = _best(candidate_literals(here, unused, class_, cuts, p.use_negation, weight), p).first()
    return body


def _least_possible(core: np.ndarray, more: np.ndarray) -> float:
    """No more than the entropy of any class counts between core and core + more: the least over the corners, as entropy has no inner minimum."""
    if len(core) > BOUNDED_CLASSES:
        return 0.0
    free = np.flatnonzero(more)
    corners = core + (np.arange(1 << len(free))[:, None] >> np.arange(len(free)) & 1) @ (np.eye(len(core), dtype="i8")[free] * more[free, None])
    totals = corners.sum(1)
    share = corners[totals > 0] / totals[totals > 0, None]
    bits = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(1)
    return float(bits.min()) - 10.0**-DIGITS if bits.size else 0.0


def _least_subset(met: np.ndarray, of_class: np.ndarray) -> tuple[tuple[bool, ...], np.ndarray]:
    """Which literals stay, and the class counts of what these cover. met says which literals each pattern of rows meets, of_class has the patterns' class counts.

    The whole body stays unless a subset has less entropy; of those with the least, the first in
    lexicographic order, leaving out before keeping. Literals are decided one after the other.
    Beginnings that cover the same patterns have the same ends, so only the first of them goes on;
    and none goes on whose entropy can't come below the whole body's, whatever is still decided.
    """
    many, patterns = met.shape[1], np.arange(met.shape[0])
    counts_of = lambda cover: of_class[cover].sum(0)
    entropy = lambda c: entropy_of(dict(enumerate(c.tolist())))
    whole = met.all(1)
    best, least = (True,) * many, entropy(counts_of(whole))
    states = {tuple(patterns.tolist()): ()}  # what is covered: the first choices that cover it
    for i in range(many):
        rest, after = met[:, i + 1 :].all(1), {}
        for cover, chosen in states.items():
            for keep in (False, True):
                now = np.array([x for x in cover if met[x, i]] if keep else cover, "i8")
                key = tuple(now.tolist())
                if key in after and after[key] <= (*chosen, keep):
                    continue
                core = counts_of(now[rest[now]])
                if _least_possible(core, counts_of(now) - core) < least:
                    after[key] = (*chosen, keep)
        states = after
    for cover, chosen in states.items():
        e = entropy(counts_of(np.array(cover, "i8")))
        if many and (e < least or e == least and best != (True,) * many and chosen < best):
            best, least = chosen, e
    return best, counts_of(met[:, [i for i in range(many) if best[i]]].all(1))


def _prune(open_rows: DataFrame, body: list[Literal], class_: str, weight: str) -> tuple[Rule, Counter]:
    """The rule of the subset of the body with the least entropy on the open rows, and its class counts; rows are counted once by which literals they meet."""
    flags = F.array(*[x.column() for x in body]) if body else F.array().cast("array<boolean>")
    cells = open_rows.select(flags.alias("met"), column(class_).alias("class"), column(weight).alias("w")).groupBy("met", "class").agg(F.sum("w").alias("n")).collect()
    classes = sorted({r["class"] for r in cells})
    patterns = sorted({tuple(r["met"]) for r in cells})
    of_class = np.zeros((len(patterns), len(classes)), "i8")
    for r in cells:
        of_class[patterns.index(tuple(r["met"])), classes.index(r["class"])] = r["n"]
    kept, counts = _least_subset(np.array(patterns, bool).reshape(len(patterns), len(body)), of_class)
    final = Counter(dict(zip(classes, counts.tolist())))
    head = majority(final) or ""
    pos = final[head]
    return Rule(tuple(x for x, keep in zip(body, kept) if keep), Literal(class_, EQ, head)).counted(pos, sum(final.values()) - pos), final
