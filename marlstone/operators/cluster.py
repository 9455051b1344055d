"""k-means over categories and numbers: a centroid has a probability for each value and a mean z-score.

A row's distance to a centroid is a sum of column expressions, so assigning rows needs no join,
and an iteration is one aggregation. Assignment follows from the model alone: whether a row has
moved is found by evaluating the last two models on it, and no lineage grows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.names import column
from marlstone.operators.tables import CONTINUOUS, DISCRETE, fresh, kind


#: Values up to which a column's are counted beside the sums of numbers, in one aggregation.
FEW_VALUES = 100


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    weight: float = 1.0
    values: tuple[str, ...] = ()
    mean: float = 0.0
    dev: float = 0.0

    def z(self) -> Column:
        """The z-score; 0 for a column without spread."""
        c = F.col(self.name)
        return (c - self.mean) / self.dev if self.dev else F.when(c.isNotNull(), 0.0)


@dataclass(frozen=True)
class Centroid:
    """By attribute: a probability of each value, or a mean z-score."""

    items: dict[str, dict[str, float] | float]
    members: int = 0


@dataclass
class ClusterModel:
    attributes: list[Attribute]
    clusters: list[Centroid]
    iterations: int = 0
    log: list[int] = field(default_factory=list)  #: rows that moved in each iteration

    def distance(self, k: int) -> Column:
        """Squared distance to a centroid; a missing value adds nothing, an unknown one has probability 0."""
        parts = []
        for a in self.attributes:
            here, c = self.clusters[k].items[a.name], F.col(a.name)
            if a.kind == DISCRETE:
                squares = sum(p * p for p in here.values())
                known = {v: p for v, p in here.items() if p}
                p = F.coalesce(F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])[c.cast("string")], F.lit(0.0)) if known else F.lit(0.0)
                d = 1 - 2 * p + squares
            else:
                d = (a.z() - here) * (a.z() - here)
            parts.append(F.when(c.isNotNull(), d * a.weight).otherwise(0.0))
        return reduce(lambda x, y: x + y, parts, F.lit(0.0))

    def assigned(self) -> Column:
        """The nearest cluster's number, the lowest of equally near ones."""
        return F.array_min(F.array(*[F.struct(F.round(self.distance(k), 12).alias("d"), F.lit(k).alias("k")) for k in range(len(self.clusters))])).getField("k")


def attributes(df: DataFrame, names: list[str] | None = None, weights: dict[str, float] | None = None) -> list[Attribute]:
    """Values of discrete columns, mean and sample deviation of numbers, without missing ones; one aggregation."""
    names = names or df.columns
    kinds = {x: kind(df, x) for x in names}
    aggs = []
    for x in names:
        if kinds[x] == DISCRETE:
            aggs.append(F.sort_array(F.collect_set(F.col(x).cast("string"))).alias(f"v_{x}"))
        else:
            aggs += [F.avg(x).alias(f"m_{x}"), F.stddev_samp(x).alias(f"s_{x}")]
    row = df.agg(*aggs).first()
    w = weights or {}
    return [
        Attribute(x, DISCRETE, w.get(x, 1.0), tuple(row[f"v_{x}"])) if kinds[x] == DISCRETE else Attribute(x, CONTINUOUS, w.get(x, 1.0), (), row[f"m_{x}"] or 0.0, row[f"s_{x}"] or 0.0)
        for x in names
    ]


def centroid_of(row, attrs: list[Attribute]) -> Centroid:
    """A centroid that is one row; a missing number is the mean, a missing category no value."""
    items: dict = {}
    for a in attrs:
        v = row[a.name]
        if a.kind == DISCRETE:
            items[a.name] = {x: float(x == v) for x in a.values}
        else:
            items[a.name] = 0.0 if v is None or not a.dev else (float(v) - a.mean) / a.dev
    return Centroid(items)


def seed_rows(df: DataFrame, attrs: list[Attribute], k: int, seed: int) -> list:
    """k rows with the smallest seeded hashes of their values; a table with fewer repeats them."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(column(a.name).cast("string"), F.lit("?")) for a in attrs]))
    rows = df.select(*[column(a.name) for a in attrs]).orderBy(key).limit(k).collect()
    if not rows:
        raise ValueError("no rows to cluster")
    return [rows[i % len(rows)] for i in range(k)]


def aggs_names(model: ClusterModel, few: list[Attribute]) -> list[str]:
    """Names of an iteration's sums."""
    out = ["n"]
    for i, a in enumerate(model.attributes):
        out += [f"s{i}", f"c{i}"] if a.kind == CONTINUOUS else [f"v{i}_{j}" for j in range(len(a.values))] if a in few else []
    return out


def updated(df: DataFrame, model: ClusterModel, previous: ClusterModel | None = None, seed: int = 42) -> tuple[ClusterModel, int]:
    """The model with means of its members as centroids, and how many rows have moved since the previous model.

    Missing values count for no column's mean. A cluster without members starts anew at a seeded row.
    """
    was = F.lit(None).cast("int") if previous is None else previous.assigned()
    cluster, before = fresh(df, "cluster"), fresh(df, "was")
    rows = df.select(*[a.name for a in model.attributes], model.assigned().alias(cluster), was.alias(before))
    aggs = [F.count("*").alias("n")]
    few = [a for a in model.attributes if a.kind == DISCRETE and len(a.values) <= FEW_VALUES]
    for i, a in enumerate(model.attributes):
        if a.kind == CONTINUOUS:
            aggs += [F.sum(a.z()).alias(f"s{i}"), F.count(a.name).alias(f"c{i}")]
        elif a in few:
            aggs += [F.count_if(F.col(a.name).cast("string") == v).alias(f"v{i}_{j}") for j, v in enumerate(a.values)]
    totals: dict[int, Counter] = {}
    moved = 0
    for r in rows.groupBy(F.col(cluster).alias("cluster"), F.col(before).alias("was")).agg(*aggs).collect():
        one = totals.setdefault(r["cluster"], Counter())
        for x in aggs_names(model, few):
            one[x] += r[x] or 0
        moved += r["n"] if r["was"] != r["cluster"] else 0
    counts: dict = {}
    for i, a in enumerate(model.attributes):
        if a in few:
            for k, one in totals.items():
                counts[k, a.name] = {v: one[f"v{i}_{j}"] for j, v in enumerate(a.values)}
    many = [a.name for a in model.attributes if a.kind == DISCRETE and a not in few]
    if many:
        long = rows.select(F.col(cluster).alias("cluster"), F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.col(x).cast("string").alias("v")) for x in many])).alias("p")).filter("p.v is not null")
        for r in long.groupBy("cluster", "p.a", "p.v").agg(F.count("*").alias("n")).collect():
            counts.setdefault((r["cluster"], r["a"]), {})[r["v"]] = r["n"]
    clusters = []
    for k in range(len(model.clusters)):
        if k not in totals:
            clusters.append(centroid_of(seed_rows(df, model.attributes, 1, seed + k + 1)[0], model.attributes))
            continue
        items: dict = {}
        for i, a in enumerate(model.attributes):
            if a.kind == DISCRETE:
                seen = counts.get((k, a.name), {})
                total = sum(seen.values())
                items[a.name] = {v: seen.get(v, 0) / total if total else 0.0 for v in a.values}
            else:
                c = totals[k][f"c{i}"]
                items[a.name] = totals[k][f"s{i}"] / c if c else 0.0
        clusters.append(Centroid(items, totals[k]["n"]))
    return ClusterModel(model.attributes, clusters, model.iterations + 1, model.log), moved


def k_means(df: DataFrame, k: int, iterations: int = 50, names: list[str] | None = None, weights: dict[str, float] | None = None, initial: list | None = None, seed: int = 42) -> ClusterModel:
    """Lloyd's iterations until no row moves or there have been as many as allowed; initial gives the first centroids as rows."""
    if k < 1 or iterations < 0:
        raise ValueError("k must be 1 or more, iterations 0 or more")
    attrs = attributes(df, names, weights)
    rows = initial if initial is not None else seed_rows(df, attrs, k, seed)
    model, previous = ClusterModel(attrs, [centroid_of(r, attrs) for r in rows]), None
    for _ in range(iterations):
        new, moved = updated(df, model, previous, seed)
        new.log.append(moved)
        if previous is not None and not moved:
            return ClusterModel(new.attributes, new.clusters, model.iterations, new.log)
        previous, model = model, new
    return model


def assign(df: DataFrame, model: ClusterModel, name: str) -> DataFrame:
    """df with the nearest cluster ('0', '1', ...) as a discrete column; values are matched by name."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    missing = [a.name for a in model.attributes if a.name not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.withColumn(name, model.assigned().cast("string")).withMetadata(name, {"kind": "d"})
