"""k-means over categories with very many values: the centroids' probabilities are a table, none of which comes to the driver.

The model is as in cluster: a probability of each value and a mean z-score for each centroid. Here
the probabilities are rows (place of the column, value, one number for each cluster), and a row's distances are

    sum over its categories of weight (1 - 2 p[value] + |p|^2)  +  sum over its numbers of weight (z - mean)^2

of which |p|^2 and the means are a few numbers for each cluster and column, and p[value] comes from a join of
the rows, exploded into their categories, with the table. Values that no member of a
cluster has take no room. An iteration writes which cluster each row is in and the new table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.names import column
from marlstone.operators.cluster import Attribute, seed_rows
from marlstone.operators.tables import CONTINUOUS, DISCRETE, fresh, kind
from marlstone.sources.files import written


@dataclass
class SparseModel:
    """table: (place, value, p0, p1, ...), place being that of the column in attributes; squares and means by cluster and place."""

    attributes: list[Attribute]
    table: DataFrame
    squares: list[dict[int, float]]
    means: list[dict[int, float]]
    members: list[int]
    iterations: int = 0
    log: list[int] = field(default_factory=list)  #: rows that moved in each iteration

    @property
    def k(self) -> int:
        return len(self.squares)

    def places(self, of_kind: str) -> list[int]:
        return [i for i, a in enumerate(self.attributes) if a.kind == of_kind]

    def centroids(self) -> DataFrame:
        """(cluster, attr, value, weight, members): probabilities over 0 of values, and means of numbers under an empty value."""
        spark = self.table.sparkSession
        names, members = F.lit([a.name for a in self.attributes]), F.lit(self.members)
        p = F.explode(F.array(*[F.struct(F.lit(k).alias("cluster"), F.col(f"p{k}").alias("weight")) for k in range(self.k)])).alias("x")
        long = self.table.select("place", "value", p).filter("x.weight > 0").select("x.cluster", F.get(names, F.col("place")).alias("attr"), "value", "x.weight")
        numbers = [(k, self.attributes[i].name, "", m) for k, means in enumerate(self.means) for i, m in means.items()]
        both = long.unionByName(spark.createDataFrame(numbers, "cluster int, attr string, value string, weight double"))
        return both.withColumn("members", F.get(members, F.col("cluster")).cast("long"))


def _attributes(df: DataFrame, names: list[str] | None, weights: dict[str, float] | None) -> list[Attribute]:
    """Mean and sample deviation of numbers; nothing is asked of categories."""
    names, w = names or df.columns, weights or {}
    kinds = {x: kind(df, x) for x in names}
    numbers = [x for x in names if kinds[x] == CONTINUOUS]
    row = df.agg(F.lit(0).alias("none"), *[f(column(x)).alias(f"{n}{i}") for i, x in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    at = {x: i for i, x in enumerate(numbers)}
    return [Attribute(x, DISCRETE, w.get(x, 1.0)) if x not in at else Attribute(x, CONTINUOUS, w.get(x, 1.0), (), row[f"m{at[x]}"] or 0.0, row[f"s{at[x]}"] or 0.0) for x in names]


def _rows(df: DataFrame, attrs: list[Attribute], *more: Column) -> DataFrame:
    """(more, v0, v1, ...): categories as text, numbers as z-scores, by place."""
    z = lambda a: (column(a.name) - a.mean) / a.dev if a.dev else F.when(column(a.name).isNotNull(), 0.0)
    return df.select(*more, *[(column(a.name).cast("string") if a.kind == DISCRETE else z(a).cast("double")).alias(f"v{i}") for i, a in enumerate(attrs)])


def _started(spark, attrs: list[Attribute], rows: list) -> SparseModel:
    """Centroids that are rows; a missing number is the mean, a missing category no value."""
    discrete = [i for i, a in enumerate(attrs) if a.kind == DISCRETE]
    ones = [(i, str(r[attrs[i].name]), k) for k, r in enumerate(rows) for i in discrete if r[attrs[i].name] is not None]
    z = lambda a, v: 0.0 if v is None or not a.dev else (float(v) - a.mean) / a.dev
    means = [{i: z(a, r[a.name]) for i, a in enumerate(attrs) if a.kind == CONTINUOUS} for r in rows]
    squares = [{i: float(r[attrs[i].name] is not None) for i in discrete} for r in rows]
    long = spark.createDataFrame(ones, "place int, value string, cluster int").withColumn("p", F.lit(1.0))
    return SparseModel(attrs, _table(long, len(rows)), squares, means, [0] * len(rows))


def _table(long: DataFrame, k: int) -> DataFrame:
    """(place, value, p0, ...) of (place, value, cluster, p)."""
    return long.groupBy("place", "value").agg(*[F.coalesce(F.sum(F.when(F.col("cluster") == i, F.col("p"))), F.lit(0.0)).alias(f"p{i}") for i in range(k)])


def _pairs(rows: DataFrame, model: SparseModel, *more: str) -> DataFrame:
    """(more, place, value) of every category of the rows that isn't missing."""
    each = [F.struct(F.lit(i).alias("place"), F.col(f"v{i}").alias("value")) for i in model.places(DISCRETE)]
    none = F.array().cast("array<struct<place:int,value:string>>")
    return rows.select(*more, F.explode(F.array(*each) if each else none).alias("x")).select(*more, "x.place", "x.value").filter(F.col("value").isNotNull())


def _nearest(rows: DataFrame, model: SparseModel, name: str) -> DataFrame:
    """rows (id, v0, ...) with the nearest cluster's number, the lowest of equally near ones."""
    weights = F.lit([float(a.weight) for a in model.attributes])
    met = _pairs(rows, model, "id").join(model.table, ["place", "value"])
    dots = met.groupBy("id").agg(*[F.sum(F.get(weights, F.col("place")) * F.col(f"p{k}")).alias(f"p{k}") for k in range(model.k)])
    near = []
    for k in range(model.k):
        d = -2 * F.coalesce(F.col(f"p{k}"), F.lit(0.0))
        for i, a in enumerate(model.attributes):
            here = 1 + model.squares[k][i] if a.kind == DISCRETE else (F.col(f"v{i}") - model.means[k][i]) * (F.col(f"v{i}") - model.means[k][i])
            d = d + F.when(F.col(f"v{i}").isNotNull(), a.weight * (F.lit(here) if a.kind == DISCRETE else here)).otherwise(0.0)
        near.append(F.struct(F.round(d, 12).alias("d"), F.lit(k).alias("k")))
    return rows.join(dots, "id", "left").withColumn(name, F.array_min(F.array(*near)).getField("k")).drop(*[f"p{k}" for k in range(model.k)])


def _updated(df: DataFrame, placed: DataFrame, model: SparseModel, seed: int) -> SparseModel:
    """The means of the clusters' members; missing values count for no column's mean, and a cluster without members starts anew at a seeded row."""
    discrete, numbers = model.places(DISCRETE), model.places(CONTINUOUS)
    sums = [F.count(f"v{i}").alias(f"c{i}") for i in (*discrete, *numbers)] + [F.sum(f"v{i}").alias(f"s{i}") for i in numbers]
    totals = {r["cluster"]: r for r in placed.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()}
    known = placed.sparkSession.createDataFrame([(k, i, r[f"c{i}"]) for k, r in totals.items() for i in discrete], "cluster int, place int, total long")
    counts = _pairs(placed, model, "cluster").groupBy("cluster", "place", "value").agg(F.count("*").alias("n"))
    long = counts.join(F.broadcast(known), ["cluster", "place"]).select("place", "value", "cluster", (F.col("n") / F.col("total")).alias("p"))  # known: clusters times columns
    empty = [k for k in range(model.k) if k not in totals]
    new = _started(df.sparkSession, model.attributes, [seed_rows(df, model.attributes, 1, seed + k + 1)[0] for k in empty]) if empty else None
    if new is not None:
        for j, k in enumerate(empty):
            long = long.unionByName(new.table.filter(F.col(f"p{j}") > 0).select("place", "value", F.lit(k).alias("cluster"), F.col(f"p{j}").alias("p")))
    table = written(_table(long, model.k), "centroids")
    found = {r["place"]: r for r in table.groupBy("place").agg(*[F.sum(F.col(f"p{k}") * F.col(f"p{k}")).alias(f"q{k}") for k in range(model.k)]).collect()}
    squares = [{i: found[i][f"q{k}"] if i in found else 0.0 for i in discrete} for k in range(model.k)]
    mean = lambda r, i: r[f"s{i}"] / r[f"c{i}"] if r[f"c{i}"] else 0.0
    means = [{i: mean(totals[k], i) for i in numbers} if k in totals else new.means[empty.index(k)] for k in range(model.k)]
    return SparseModel(model.attributes, table, squares, means, [totals[k]["n"] if k in totals else 0 for k in range(model.k)], model.iterations + 1, model.log)


def k_means_sparse(df: DataFrame, k: int, iterations: int = 50, names: list[str] | None = None, weights: dict[str, float] | None = None, initial: list | None = None, seed: int = 42) -> SparseModel:
    """cluster.k_means() for columns of any number of values: the same iterations, from the same rows to the same centroids. A value of initial that no row has is as far from all rows as any other."""
    if k < 1 or iterations < 0:
        raise ValueError("k must be 1 or more, iterations 0 or more")
    attrs = _attributes(df, names, weights)
    model = _started(df.sparkSession, attrs, initial if initial is not None else seed_rows(df, attrs, k, seed))
    # written once, so that a row's number stays its own
    placed = written(_rows(df, attrs, F.monotonically_increasing_id().alias("id"), F.lit(None).cast("int").alias("cluster")), "rows")
    for step in range(iterations):
        now = written(_nearest(placed.withColumnRenamed("cluster", "was"), model, "cluster"), "rows")
        moved = now.filter(~F.col("cluster").eqNullSafe(F.col("was"))).count()
        placed = now.drop("was")
        model.log.append(moved)
        if step and not moved:
            # as the last model's members are the same, its means are what they would be now; only its number of iterations tells
            return SparseModel(model.attributes, model.table, model.squares, model.means, model.members, model.iterations, model.log)
        model = _updated(df, placed, model, seed)
    return model


def assign_sparse(df: DataFrame, model: SparseModel, name: str) -> DataFrame:
    """df with the nearest cluster ('0', '1', ...) as a discrete column; values are matched by name, and rows are numbered for the time being."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    id_ = fresh(df, "_id")
    rows = written(df.withColumn(id_, F.monotonically_increasing_id()), "rows")
    found = _nearest(_rows(rows, model.attributes, F.col(id_).alias("id")), model, "_cluster").select(F.col("id").alias(id_), F.col("_cluster").cast("string").alias(name))
    return rows.join(found, id_).drop(id_).withMetadata(name, {"kind": "d"})
