"""Which rules of a list cover a row, found through an index from literals to rules.

Rows are reduced to what rules can tell of them: their values of the columns in bodies, a number
being only the place of its value among the thresholds of its column. The distinct ones of these
are exploded into items and joined with the index (item, rule), which has each rule under one of
its literals, that which fewest rules share; the others are then tested on the pairs found. A range of places
stands in the index as a few ranges of an aligned binary tree, and a number's items are the nodes above its
place, so that it finds each range that it is in once.

No plan holds a condition for each rule, and rows themselves meet only their result, by a join
that Spark makes a broadcast where the distinct rows turn out to be few.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.itemsets import item_name
from marlstone.functions.names import column
from marlstone.operators.rules import EQ, LE, NEQ, Rule
from marlstone.operators.tables import CONTINUOUS, DISCRETE, fresh

#: The item that every row has, for rules that ask for nothing.
ANY = "*"
#: Rules from which on a list is matched by the index.
LONG_LIST = 200


def _thresholds(rules: list[Rule]) -> dict[str, list[float]]:
    out: dict[str, set[float]] = {}
    for x in (x for r in rules for x in r.body if x.kind == CONTINUOUS):
        out.setdefault(x.attr, set()).add(x.value)
    return {a: sorted(v) for a, v in sorted(out.items())}


def _node(attr: str, level: int, place: int) -> str:
    return f"{item_name(attr)}#{level}#{place}"


def _nodes(first: int, last: int) -> list[tuple[int, int]]:
    """The fewest aligned ranges of 2^level places that make up first to last."""
    out, level = [], 0
    last += 1
    while first < last:
        if first & 1:
            out.append((level, first))
            first += 1
        if last & 1:
            last -= 1
            out.append((level, last))
        first, last, level = first >> 1, last >> 1, level + 1
    return out


def _place(value: Column, cuts: list[float]) -> Column:
    """How many of the thresholds are below a value, by halving; NaN is over all."""
    known = F.from_json(F.lit(json.dumps(cuts)), "array<double>")  # one literal, however many there are

    def step(at: Column, level: Column) -> Column:
        to = at + F.call_function("shiftleft", F.lit(1), level)
        return F.when((to <= len(cuts)) & (F.get(known, to - 1) < value), to).otherwise(at)

    return F.aggregate(F.sequence(F.lit(len(cuts).bit_length() - 1), F.lit(0), F.lit(-1)), F.lit(0), step)


def _nodes_above(attr: str, value: Column, cuts: list[float]) -> Column:
    """The nodes above a number's place among its thresholds; none if it is missing."""
    levels, name = F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), F.lit(f"{item_name(attr)}#")

    def above(place: Column) -> Column:
        return F.transform(levels, lambda n: F.concat(name, n.cast("string"), F.lit("#"), F.call_function("shiftright", place, n).cast("string")))

    nodes = F.element_at(F.transform(F.array(_place(value, cuts)), above), 1)  # the place is found once, not for each level
    return F.when(value.isNotNull(), nodes).otherwise(F.array().cast("array<string>"))


def items(rules: list[Rule]) -> Column:
    """The items of a row, as an array: one for each discrete column of bodies, and the nodes above each number's place among its thresholds."""
    discrete = sorted({x.attr for r in rules for x in r.body if x.kind == DISCRETE})
    parts = [F.array(F.lit(ANY), *[F.concat(F.lit(f"{item_name(a)}="), column(a).cast("string")) for a in discrete])]
    return F.array_compact(F.concat(*parts, *[_nodes_above(a, column(a).cast("double"), cuts) for a, cuts in _thresholds(rules).items()]))


def places(rules: list[Rule]) -> Column:
    """The places of a row's numbers among their thresholds, in the order of the columns' names; null where a number is missing."""
    found = [F.when(column(a).isNotNull(), _place(column(a).cast("double"), cuts)) for a, cuts in _thresholds(rules).items()]
    return F.array(*found).cast("array<int>")


_INDEX = pa.schema([("item", pa.string()), ("rule", pa.int32()), ("wanted", pa.list_(pa.string())), ("forbidden", pa.list_(pa.string())), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])


def index(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(item, rule, wanted, forbidden, low, high): the items of a rule's equalities and of its inequalities, and the least and largest place of each number; item is
    the one under which it is found, or one of a few."""
    thresholds = _thresholds(rules)
    place = {a: {t: k for k, t in enumerate(cuts)} for a, cuts in thresholds.items()}
    text = lambda x: f"{item_name(x.attr)}={x.value}"
    shared = Counter(text(x) for r in rules for x in r.body if x.op == EQ)
    out: list[list] = [[] for _ in _INDEX]
    for i, r in enumerate(rules):
        wanted, forbidden = [text(x) for x in r.body if x.op == EQ], [text(x) for x in r.body if x.op == NEQ]
        ranges: dict[str, tuple[int, int]] = {}
        for x in r.body:
            if x.kind == CONTINUOUS:
                low, high = ranges.get(x.attr, (0, len(thresholds[x.attr])))
                k = place[x.attr][x.value]
                ranges[x.attr] = (low, min(high, k)) if x.op == LE else (max(low, k + 1), high)
        if wanted:
            under = [min(wanted, key=lambda w: shared[w])]
        elif ranges:
            a, (low, high) = min(ranges.items(), key=lambda x: x[1][1] - x[1][0])
            under = [_node(a, *n) for n in _nodes(low, high)]
        else:
            under = [ANY]
        low, high = ([ranges[a][k] if a in ranges else None for a in thresholds] for k in (0, 1))
        for item in under:
            for c, value in zip(out, (item, i, wanted, forbidden, low, high)):
                c.append(value)
    return df.sparkSession.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(out, _INDEX)], schema=_INDEX))


def _fired(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(items, rule) of every rule that covers a distinct row (items, places)."""
    each = rows.select("items", "places").distinct().select("items", "places", F.explode("items").alias("item"))
    within = "forall(zip_with(arrays_zip(low, high), places, (r, p) -> r.low IS NULL OR coalesce(p BETWEEN r.low AND r.high, false)), x -> x)"
    return each.join(index(rows, rules), "item").filter(f"size(array_except(wanted, items)) = 0 AND NOT arrays_overlap(forbidden, items) AND {within}").select("items", "rule")


def with_places(df: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """df with the places in the list, from 0 and in order, of all rules that cover a row."""
    if len(rules) <= LONG_LIST:
        found = F.array_compact(F.array(*[F.when(r.covers(), F.lit(i)) for i, r in enumerate(rules)])) if rules else F.array().cast("array<int>")
        return df.withColumn(name, found)
    return _joined(df, rules, lambda fired: fired.groupBy("items").agg(F.sort_array(F.collect_list("rule")).alias("found")), name, F.array().cast("array<int>"))


def with_first_head(df: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """df with the head's value of the first rule that covers a row, null where none does; by the index, whatever the list's length."""
    heads = df.sparkSession.createDataFrame(pa.table({"rule": pa.array(range(len(rules)), pa.int32()), "found": pa.array([r.head.value for r in rules], pa.string())}))

    def first(fired: DataFrame) -> DataFrame:
        return fired.groupBy("items").agg(F.min("rule").alias("rule")).join(heads, "rule").select("items", "found")

    return _joined(df, rules, first, name, None)


def _joined(df: DataFrame, rules: list[Rule], of: Callable[[DataFrame], DataFrame], name: str, otherwise: Column | None) -> DataFrame:
    """df with what of() says of the rules that cover a row."""
    key = fresh(df, "_items")
    rows = df.withColumn(key, items(rules))
    said = of(_fired(rows.select(F.col(key).alias("items"), places(rules).alias("places")), rules)).select(F.col("items").alias(key), F.col("found").alias(name))
    out = rows.join(said, key, "left").drop(key)
    return out if otherwise is None else out.withColumn(name, F.coalesce(column(name), otherwise))
