"""Exact search for the largest inner products with M-trees.

Vectors of whole numbers get one more component, sqrt(M - |x|^2) with M the largest squared
length, and queries get 0 there. Then the squared distance of a query q from x is |q|^2 + M - 2 qx, so
the largest inner products are the nearest neighbours in a metric space, whose triangle
inequality an M-tree makes use of.

All vectors are indexed. They are dealt to ranges by the nearest of at most PIVOTS of them (which
decides speed only), and every range is cut into trees of at most TREE vectors. A tree is a row: pages of nodes, each with
a vector of its own, a covering radius and its distance from its parent's vector, and pages of
vectors with their distance from their node's. A search takes nodes best first; a child or vector
is passed over without its distance being computed if the stored distance and that of the parent show
that it is too far away.

A query is searched for in its own tree first. The score of its k-th best there is a floor for
the others: only trees whose ball reaches that far are searched at all. Queries are taken in the
blocks in which trees hold them, and trees' balls in pages, so that no task sees all of either.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

#: What a component is multiplied by before it is cut to a whole number; results of a query.
SCALE, K = 256, 5
#: Vectors of a tree, and of a page of vectors; children of a node; vectors by whose nearest the others are dealt, a sample by hash; balls of a page.
TREE, PAGE, CHILDREN, PIVOTS, BALLS = 4096, 256, 16, 256, 512
#: Squared lengths up to which sums of products are exact in double precision.
EXACT = float(1 << 52)
#: A share of the lengths by which distances are taken to be off at most.
SLACK = 1e-9
_NODE = np.dtype([("row", "<i4"), ("radius", "<f8"), ("apart", "<f8"), ("first", "<i4"), ("last", "<i4"), ("leaf", "u1")])


class MTree:
    """ids, vectors and apart of entries, in the order of their pages; nodes, a parent's children next to each other, the root first."""

    def __init__(self, dim: int, m: float, ids: bytes, vectors: bytes, apart: bytes, nodes: bytes):
        self.ids, self.m = np.frombuffer(ids, "<i8"), m
        self.x = _vectors(vectors, len(self.ids), dim)
        self.apart, self.nodes = np.frombuffer(apart, "<f8"), np.frombuffer(nodes, _NODE)

    def search(self, q: np.ndarray, k: int, floor: float = -np.inf, own: int = -1) -> list[tuple[int, int]]:
        """(score, id) of the k best of at least floor, ties to smaller ids; own is the row that is the query itself."""
        size = float(q @ q)
        slack = SLACK * (np.sqrt(size) + np.sqrt(self.m))
        best: list[tuple[float, int]] = []  # the worst first: (score, -id)

        def reach() -> float:
            least = best[0][0] if len(best) == k else floor
            return np.inf if least == -np.inf else np.sqrt(max(0.0, size + self.m - 2 * least)) + slack

        def distance(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, size + self.m - 2 * (self.x[rows] @ q)))

        nodes, far = self.nodes, reach()
        d = float(distance(nodes["row"][:1])[0])
        waiting = [(d - float(nodes["radius"][0]), 0, d)]
        while waiting:
            nearest, i, d = heapq.heappop(waiting)
            if nearest > far:
                break
            first, last = int(nodes["first"][i]), int(nodes["last"][i])
            if nodes["leaf"][i]:
                rows = first + np.flatnonzero(np.abs(d - self.apart[first:last]) <= far)
                scores = self.x[rows] @ q
                least = best[0][0] if len(best) == k else floor
                for row, score in zip(rows[hit := scores >= least].tolist(), scores[hit].tolist()):
                    found = (score, -int(self.ids[row]))
                    if row == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                far = reach()
            else:
                radius = nodes["radius"][first:last]
                child = np.flatnonzero(np.abs(d - nodes["apart"][first:last]) - radius <= far)
                away = distance(nodes["row"][first + child])
                for c, x, near in zip(child.tolist(), away.tolist(), (away - radius[child]).tolist()):
                    if near <= far:
                        heapq.heappush(waiting, (near, first + c, x))
        return [(int(score), -minus) for score, minus in sorted(best, key=lambda x: (-x[0], -x[1]))]


def _vectors(data: bytes, n: int, dim: int) -> np.ndarray:
    width = len(data) // max(1, n * dim)
    return np.frombuffer(data, f"<i{width}" if width else "<i2").reshape(n, dim).astype("f8")


def build(x: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, their distances from their page's node, and the nodes of a tree over the rows of x."""
    sizes = (x * x).sum(1)
    more, rng = np.sqrt(np.maximum(0.0, m - sizes)), np.random.default_rng(len(x))

    def distances(i: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, sizes[i] + sizes[rows] - 2 * (x[rows] @ x[i]) + (more[rows] - more[i]) ** 2))

    order, apart, done = [], [], 0
    every = np.arange(len(x))
    nodes, members = [(int(((x - x.mean(0)) ** 2).sum(1).argmin()), 0.0)], [every]
    out = []
    while len(out) < len(nodes):
        (row, from_parent), rows = nodes[len(out)], members[len(out)]
        away = distances(row, rows)
        if len(rows) <= PAGE:
            out.append((row, away.max(), from_parent, done, done + len(rows), 1))
            order.append(rows)
            apart.append(away)
            done += len(rows)
        else:
            many = min(CHILDREN, -(-len(rows) // PAGE))
            chosen = rng.permutation(len(rows))[:many]
            nearest = np.stack([distances(int(rows[c]), rows) for c in chosen]).argmin(0)
            if np.bincount(nearest).max() == len(rows):  # nothing tells them apart
                nearest, chosen = np.arange(len(rows)) * many // len(rows), np.searchsorted(np.arange(len(rows)) * many // len(rows), np.arange(many))
            groups = [g for g in range(many) if (nearest == g).any()]
            out.append((row, away.max(), from_parent, len(nodes), len(nodes) + len(groups), 0))
            nodes += [(int(rows[chosen[g]]), float(away[chosen[g]])) for g in groups]
            members += [rows[nearest == g] for g in groups]
        members[len(out) - 1] = every[:0]
    placed = np.concatenate(order)
    at = np.empty(len(x), "i8")
    at[placed] = every
    made = np.array(out, _NODE)
    made["row"] = at[made["row"]]
    return placed, np.concatenate(apart), made


def whole_numbers(vectors: DataFrame, query: Column, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, query, dim, v: vectors as arrays of whole numbers; rows without id or with null or non-finite components are left out."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("query"), F.col(embedding).cast("array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite)
    return rows.select("vec_id", "query", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * SCALE)).alias("v"))


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """vec_id, query, dim, pivot (the nearest of a sample), v as bytes."""
    chosen = [(r["dim"], r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]
    pivots = {d: np.array([v for dim, v in chosen if dim == d], "f8") for d in {d for d, _ in chosen}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, all_ = batch.column(2).to_numpy(), batch.column(3)
            pivot, data = np.zeros(batch.num_rows, "i4"), np.empty(batch.num_rows, object)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = all_.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                if d in pivots:
                    p = pivots[d]
                    pivot[at] = ((p * p).sum(1) - 2 * (x.astype("f8") @ p.T)).argmin(1)
                small = x.astype(f"<i{width}")
                data[at] = [small[i].tobytes() for i in range(len(at))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(pivot), pa.array(data.tolist(), pa.binary())], ["vec_id", "query", "dim", "pivot", "v"])

    return rows.mapInArrow(run, "vec_id long, query boolean, dim int, pivot int, v binary")


_TREES = (
    "tree long, dim int, ids binary, vectors binary, apart binary, nodes binary, centre binary, radius double, "
    "n_queries int, q_rows binary, q_ids binary, q_vectors binary, q_floors binary, home array<struct<row: int, query_id: long, vec_id: long, score: long>>"
)


def _grown(dim: int, ids: np.ndarray, query: np.ndarray, raw: list[bytes], m: float, k: int) -> dict:
    """A tree of some rows, with its queries and what they find in it."""
    vectors = b"".join(raw)
    placed, apart, nodes = build(_vectors(vectors, len(ids), dim), m)
    raw_placed, ids, query = [raw[i] for i in placed], ids[placed].astype("<i8"), query[placed]
    tree = MTree(dim, m, ids.tobytes(), b"".join(raw_placed), apart.tobytes(), nodes.tobytes())
    asked = np.flatnonzero(query)
    found = [tree.search(tree.x[i], k, own=i) for i in asked.tolist()]
    return {
        "dim": dim, "ids": ids.tobytes(), "vectors": b"".join(raw_placed), "apart": apart.tobytes(), "nodes": nodes.tobytes(),
        "centre": tree.x[nodes["row"][0]].tobytes(), "radius": float(nodes["radius"][0]), "n_queries": len(asked), "q_rows": asked.astype("<i4").tobytes(),
        "q_ids": ids[asked].tobytes(), "q_vectors": b"".join(raw_placed[i] for i in asked),
        "q_floors": np.array([f[-1][0] if len(f) == k else -np.inf for f in found], "<f8").tobytes(),
        "home": [{"row": i, "query_id": int(ids[i]), "vec_id": v, "score": s} for i, f in zip(asked.tolist(), found) for s, v in f],
    }


def trees(dealt: DataFrame, m: float, k: int = K) -> DataFrame:
    """A row for every tree; each has vectors of one length, most of them near one pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, made = _schema(), 0
        ids, query, raw, of = [], [], [], None

        def ended() -> pa.RecordBatch:
            row = _grown(of, np.array(ids, "i8"), np.array(query, bool), raw, m, k)
            return pa.RecordBatch.from_pylist([row | {"tree": (TaskContext.get().partitionId() << 32) + made}], schema=schema)

        for batch in batches:
            for id_, asks, dim, v in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if raw and (dim != of or len(raw) == TREE):
                    yield ended()
                    made, ids, query, raw = made + 1, [], [], []
                of = dim
                ids.append(id_)
                query.append(asks)
                raw.append(v)
        if raw:
            yield ended()

    ranged = dealt.withColumn("h", F.xxhash64("vec_id", "v")).repartitionByRange("dim", "pivot", "h").sortWithinPartitions("dim", "pivot", "h").drop("h")
    return ranged.mapInArrow(run, _TREES)


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    home = pa.list_(pa.struct([("row", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
    return pa.schema([(name, kinds.get(kind, home)) for name, kind in (x.split(" ")[:2] for x in _TREES.split(", home")[0].split(", "))] + [("home", home)])


def _routes(grown: DataFrame, m: float) -> DataFrame:
    """(tree, home, rows, ids, vectors, floors): the queries of each block that a tree's ball can hold something for, but those that live in it."""
    n = grown.count()
    pages, lanes = max(1, n // BALLS), max(1, n // (8 * BALLS))
    each = lambda name, many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias(name)
    slot = lambda many: F.pmod(F.xxhash64("tree"), F.lit(many))
    balls = grown.select(slot(pages).alias("page"), F.struct("tree", "dim", "centre", "radius").alias("ball"), each("lane", lanes))
    balls = balls.groupBy("page", "lane").agg(F.collect_list("ball").alias("balls"))
    blocks = grown.filter("n_queries > 0").select(F.col("tree").alias("home"), "dim", "q_rows", "q_ids", "q_vectors", "q_floors", slot(lanes).alias("lane"), each("page", pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, floors = row["dim"], np.frombuffer(row["q_floors"], "<f8")
                q = _vectors(row["q_vectors"], len(floors), dim)
                size = (q * q).sum(1)
                reach = np.where(floors == -np.inf, np.inf, np.sqrt(np.maximum(0.0, size + m - 2 * np.where(floors == -np.inf, 0.0, floors))) + SLACK * (np.sqrt(size) + np.sqrt(m)))
                balls = [b for b in row["balls"] if b["dim"] == dim and b["tree"] != row["home"]]
                if not balls:
                    continue
                centres = np.stack([np.frombuffer(b["centre"], "<f8") for b in balls])
                away = np.sqrt(np.maximum(0.0, size[:, None] + m - 2 * (q @ centres.T))) - np.array([b["radius"] for b in balls])
                wanted, width = away <= reach[:, None], len(row["q_vectors"]) // len(floors)
                rows, ids = np.frombuffer(row["q_rows"], "<i4"), np.frombuffer(row["q_ids"], "<i8")
                for b, hit in zip(balls, wanted.T):
                    if hit.any():
                        kept = b"".join(row["q_vectors"][i * width : (i + 1) * width] for i in np.flatnonzero(hit).tolist())
                        yield pa.RecordBatch.from_pydict({"tree": [b["tree"]], "home": [row["home"]], "rows": [rows[hit].tobytes()], "q_ids": [ids[hit].tobytes()], "q_vectors": [kept], "floors": [floors[hit].tobytes()]})

    met = blocks.join(balls, ["page", "lane"]).select("home", "dim", "q_rows", "q_ids", "q_vectors", "q_floors", "balls")
    return met.mapInArrow(run, "tree long, home long, rows binary, q_ids binary, q_vectors binary, floors binary")


def top_k(vectors: DataFrame, query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows with the largest inner products for every row that is a query: query_id, rank (from 1), vec_id, score; ties go to smaller ids, all rows if there are fewer.

    Components are cut to whole numbers, SCALE times their size, so scores are exact. A row is no
    candidate for itself; rows under an id that occurs again are candidates for each other, and
    each a query of its own. Rows without id, and vectors that are null or have null or non-finite components, take no part; a
    vector is compared with those of its own length. An empty table gives no rows, other columns
    are ignored. Vectors whose squared length times SCALE^2 isn't below 2^52 are an error, as
    their products couldn't be exact.
    """
    rows = whole_numbers(vectors, query, vec_id, embedding)
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = rows.agg(F.max(size).alias("m"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first()
    m, most = float(stats["m"] or 0.0), stats["most"] or 0
    if m >= EXACT:
        raise ValueError("vectors are too long for exact products")
    grown = materialise(trees(_dealt(rows, 2 if most < 1 << 15 else 4), m, k), "trees")
    packs = _routes(grown, m)
    met = packs.join(grown.select("tree", "dim", "ids", "vectors", "apart", "nodes"), "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["tree"] != held:
                    held, tree = row["tree"], MTree(row["dim"], m, row["ids"], row["vectors"], row["apart"], row["nodes"])
                ids, floors = np.frombuffer(row["q_ids"], "<i8").tolist(), np.frombuffer(row["floors"], "<f8").tolist()
                q, places = _vectors(row["q_vectors"], len(ids), row["dim"]), np.frombuffer(row["rows"], "<i4").tolist()
                found = [(row["home"], place, id_, v, s) for i, (id_, place, floor) in enumerate(zip(ids, places, floors)) for s, v in tree.search(q[i], k, floor)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["home", "row", "query_id", "vec_id", "score"])

    away = met.select("tree", "home", "rows", "q_ids", "q_vectors", "floors", "dim", "ids", "vectors", "apart", "nodes").mapInArrow(run, "home long, row int, query_id long, vec_id long, score long")
    at_home = grown.select(F.col("tree").alias("home"), F.explode("home").alias("x")).select("home", "x.row", "x.query_id", "x.vec_id", "x.score")
    best = Window.partitionBy("home", "row").orderBy(F.desc("score"), "vec_id")
    ranked = at_home.unionByName(away).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
