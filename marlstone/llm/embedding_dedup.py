"""Embedding near-dedup with randomised-rotation binary codes and stored correction factors.

A unit vector is rotated at random. Its signs are its code, PLANES - 1 more bits a component
refine it, and its correction factor is the inner product of the rotated vector with its code
(as a unit vector). All of this is stored packed with the vector's id. The inner product of one
vector's code with another's refined form, divided by the factor, estimates that of the two
vectors without bias; it is computed from the packed planes by AND and counts of bits. The part of
the code that is orthogonal to its vector is in a random direction, so a pair at the threshold
has an estimate far below it with a small probability only: that confidence bound decides
which pairs are computed anew in double precision, and only the vectors of such pairs are fetched.

Pairs to look at come from buckets: vectors of one label that agree in a band of signs of
further rotations, stored packed as well. The number of bands follows from the number of bits so that a pair at the
threshold shares none with a probability of MISS at most; pairs closer than that are missed far
more rarely. A pair counts in the first band that it shares. Buckets are compared block by
block; what leaves a block is a count for each vector and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import connected_components, join_groups, local_components, materialise

#: MISS is the probability with which a pair at the threshold may share no band, and with which its estimate may miss the bound.
THRESHOLD, MISS, SEED = 0.98, 1e-6, 11
#: Vectors that a bucket of unrelated vectors should hold, from which the bits of a band follow; bits at least and at most.
BUCKET, LEAST_BITS, MOST_BITS = 512, 4, 24
#: Vectors of a block; a larger bucket is split into blocks, which meet in pairs.
BLOCK = 2048
#: Rows and columns of a tile of estimates.
TILE = 512
#: Bits a component in a code's refined form, the sign included: its levels are the odd numbers from 1 - 2 ** PLANES to 2 ** PLANES - 1.
PLANES = 4


def bands(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Bands of so many bits after which a pair at the threshold has been missed with a probability of miss."""
    agree = 1 - math.acos(min(threshold, 1 - 1e-12)) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_signs(unit: np.ndarray, bits: int, count: int, seed: int) -> np.ndarray:
    """n x count x bits: the signs of bits directions for each band, from as many rotations as are needed."""
    dim, need = unit.shape[1], bits * count
    signs = np.concatenate([unit @ rotation(dim, seed + 1 + i).T > 0 for i in range(-(-need // dim))], axis=1)[:, :need]
    return signs.reshape(len(unit), count, bits)


def _words(bits: np.ndarray) -> np.ndarray:
    """Packs the last axis of booleans into whole 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    out = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), "u1")
    out[..., : packed.shape[-1]] = packed
    return out.view("<u8")


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed planes of each vector (n x PLANES x words, signs first, then the refining bits from the highest) and its numbers (n x 3):

    the correction factor of its code, the width of a level, and the length of what the refined form leaves out.
    """
    dim = unit.shape[1]
    rotated = unit @ rotation(dim, seed).T
    positive, top = rotated > 0, (1 << PLANES) - 1
    factor = np.abs(rotated).sum(axis=1) / math.sqrt(dim)
    width = np.abs(rotated).max(axis=1) / (top + 1)
    # level (2 u - top) for u in 0 .. top; a level's sign is the component's
    u = np.clip(np.floor(rotated / (2 * width[:, None])) + (top + 1) // 2, 0, top).astype("i8")
    u = np.where(positive, np.maximum(u, (top + 1) // 2), np.minimum(u, (top - 1) // 2))
    left = np.linalg.norm(rotated - width[:, None] * (2 * u - top), axis=1)
    planes = np.stack([_words((u >> k & 1).astype(bool)) for k in range(PLANES - 1, -1, -1)], axis=1)
    return planes, np.stack([factor, width, left], axis=1).astype("f4")


def estimates(a: np.ndarray, numbers_a: np.ndarray, b: np.ndarray, numbers_b: np.ndarray, dim: int) -> np.ndarray:
    """The estimated inner product of each of a with each of b, from a's codes and factors and b's planes and widths."""
    code = a[:, 0]
    total = np.zeros((len(a), len(b)), "i4")
    for k in range(PLANES):
        plane = b[:, k]
        # the sum over components of sign(a) * bit(b): twice the bits that both have, less those of b
        both = sum(np.bitwise_count(code[:, None, w] & plane[None, :, w]).astype("i4") for w in range(code.shape[1]))
        total += (2 * both - np.bitwise_count(plane).sum(axis=1, dtype="i4")[None, :]) << (PLANES - 1 - k)
    signs = 2 * np.bitwise_count(code).sum(axis=1, dtype="i4") - dim
    levels = 2 * total - ((1 << PLANES) - 1) * signs[:, None]
    return levels * numbers_b[None, :, 1] / (numbers_a[:, None, 0] * math.sqrt(dim))


def slack(numbers_a: np.ndarray, numbers_b: np.ndarray, dim: int, threshold: float, miss: float = MISS) -> np.ndarray:
    """How far below its inner product, which is threshold or more, a pair's estimate is, but for a probability of miss.

    Both parts of the error are products with unit vectors in random directions, of which a
    component exceeds x / sqrt(dim - 1) with a probability of 2 exp(-x * x / 2) at most.
    """
    factor = numbers_a[:, None, 0].astype("f8")
    orthogonal = np.sqrt(np.maximum(0, 1 - factor**2)) * math.sqrt(max(0.0, 1 - threshold**2)) / factor
    cut = numbers_b[None, :, 2] / factor
    sure = math.sqrt(2 * math.log(4 / miss))
    # in few dimensions the largest errors there can be are smaller than such bounds
    return np.minimum(1.0, sure / math.sqrt(max(1, dim - 1))) * (orthogonal + cut) + 1e-5


def open_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, dim: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b; within a, first < second, if b is None) whose bound leaves open whether they reach the threshold, tile by tile."""
    right = a if b is None else b
    for i in range(0, len(a[0]), TILE):
        for j in range(i if b is None else 0, len(right[0]), TILE):
            pa_, na = a[0][i : i + TILE], a[1][i : i + TILE]
            pb, nb = right[0][j : j + TILE], right[1][j : j + TILE]
            x, y = np.nonzero(estimates(pa_, na, pb, nb, dim) >= threshold - slack(na, nb, dim, threshold))
            x, y = x + i, y + j
            yield (x[x < y], y[x < y]) if b is None else (x, y)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype("f8")
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _batch(columns: dict[str, pa.Array | np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _rows(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(matrix)], pa.binary())


CODES = "node bigint, label string, dim int, weight bigint, planes binary, numbers binary, signs binary, keys array<bigint>"


def _encoder(bits: int, seed: int, threshold: float):
    count = bands(bits, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, weight, node, label = (batch.column(i) for i in range(4))
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                unit = _unit(values[starts[at][:, None] + np.arange(dim)])
                signs = band_signs(unit, bits, count, seed)
                keys = signs @ (1 << np.arange(bits, dtype="i8"))
                planes, numbers = encode(unit, seed)
                take = pa.array(at)
                yield _batch({
                    "node": node.take(take), "label": label.take(take), "dim": np.full(len(at), dim, "i4"), "weight": weight.take(take), "planes": _rows(planes),
                    "numbers": _rows(numbers), "signs": _rows(np.packbits(signs.reshape(len(at), -1), axis=1, bitorder="little")), "keys": pa.array(list(keys), pa.list_(pa.int64())),
                })

    return run


class _Block:
    """Rows of a block or of a pair of blocks, and which of their pairs are open and meet in this band first."""

    def __init__(self, rows: pa.Table, bits: int):
        column = lambda name: rows.column(name).combine_chunks() if isinstance(rows.column(name), pa.ChunkedArray) else rows.column(name)
        self.node, self.weight, self.side = (column(x).to_numpy() for x in ("node", "weight", "side"))
        self.dim, self.band, self.bits = int(rows.column("dim")[0].as_py()), int(rows.column("band")[0].as_py()), bits
        self.planes = _matrix(column("planes"), "<u8").reshape(len(self.node), PLANES, -1)
        self.numbers = _matrix(column("numbers"), "<f4")
        signs = np.unpackbits(_matrix(column("signs"), "u1"), axis=1, count=self.band * bits, bitorder="little") if self.band else np.zeros((len(self.node), 0), "u1")
        self.earlier = np.packbits(signs.reshape(len(self.node), self.band, bits), axis=2, bitorder="little")
        vectors = column("embedding").flatten().to_numpy().reshape(len(self.node), -1) if "embedding" in rows.column_names else None
        self.units = None if vectors is None else _unit(vectors)

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Open pairs of rows that share no earlier band."""
        both = bool((self.side != 0).any())
        left, right = np.flatnonzero(self.side <= 0), np.flatnonzero(self.side > 0)
        if both and (not len(left) or not len(right)):
            return
        part = lambda at: (self.planes[at], self.numbers[at])
        for x, y in open_pairs(part(left), part(right) if both else None, self.dim, threshold):
            x, y = left[x], (right if both else left)[y]
            if self.band and len(x):
                first = np.concatenate([~(self.earlier[x[i : i + 65536]] == self.earlier[y[i : i + 65536]]).all(axis=2).any(axis=1) for i in range(0, len(x), 65536)])
                x, y = x[first], y[first]
            if len(x):
                yield x, y

    def open_nodes(self, threshold: float) -> pa.Array:
        seen = np.zeros(len(self.node), bool)
        for x, y in self.pairs(threshold):
            seen[x] = seen[y] = True
        return pa.array(seen)

    def links(self, threshold: float) -> pa.RecordBatch | None:
        """Number of links and root in the block's forest for each node that has any, from open pairs computed anew."""
        low, count = np.arange(len(self.node)), np.zeros(len(self.node), "i8")
        for x, y in self.pairs(threshold):
            for k in range(0, len(x), 65536):
                p, q = x[k : k + 65536], y[k : k + 65536]
                ok = np.einsum("ij,ij->i", self.units[p], self.units[q]) >= threshold
                p, q = p[ok], q[ok]
                np.add.at(count, p, self.weight[q])
                np.add.at(count, q, self.weight[p])
                low = local_components(len(low), low[p], low[q])[low]
        out = np.flatnonzero(count > 0)
        if not len(out):
            return None
        return _batch({"node": self.node[out], "links": count[out], "root": self.node[low[out]]})


#: Two hashes together tell comparisons apart.
GROUP = ("group", "check")


def _by_group(work):
    """Applies work to the rows of each group of at least two, of batches sorted by group; a batch and a group are all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            cuts = np.flatnonzero(np.any([np.diff(held.column(x).to_numpy()) != 0 for x in GROUP], axis=0)) + 1
            start = 0
            for end in cuts.tolist():
                if end - start > 1 and (found := work(held.slice(start, end - start))) is not None:
                    yield found
                start = end
            held = held.slice(start)
        if held is not None and held.num_rows > 1 and (found := work(held)) is not None:
            yield found

    return run


def _opened(threshold: float, bits: int):
    def work(rows: pa.Table) -> pa.RecordBatch | None:
        found = rows.filter(_Block(rows, bits).open_nodes(threshold)).combine_chunks()
        return found.to_batches()[0] if found.num_rows else None

    return _by_group(work)


def _linked(threshold: float, bits: int):
    return _by_group(lambda rows: _Block(rows, bits).links(threshold))


def _placed(codes: DataFrame) -> DataFrame:
    """codes once for each band and block in which a vector is compared, with the group that is one such comparison."""
    at = [F.col("label"), F.col("dim"), F.posexplode("keys").alias("band", "key")]
    sizes = codes.select(*at).groupBy("label", "dim", "band", "key").agg(F.count("*").alias("n"))
    large = materialise(sizes.filter(F.col("n") > BLOCK), "large")
    placed = codes.select("node", "weight", "planes", "numbers", "signs", *at).join(large, ["label", "dim", "band", "key"], "left")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "band"), blocks).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # a block meets itself with side 0, another as the lower (-1) or the higher (1) of the two
    side: Column = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    met = ("label", "dim", "band", "key", F.least("own", "other"), F.greatest("own", "other"))
    group = [F.xxhash64(F.lit(x), *met).alias(x) for x in GROUP]
    return placed.select(*group, "node", "weight", "dim", "planes", "numbers", "signs", F.col("band").cast("byte").alias("band"), side.cast("byte").alias("side"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(GROUP[0]).sortWithinPartitions(*GROUP, "node")


def embedding_dedup(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Every row's vec_id, n_links, component_id (smallest vec_id reachable by links, itself included), kept.

    Vectors of one label (not null) and length link with a cosine of threshold or more. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing. Equal
    vectors of a label are looked at once and link with each other. Rows repeated under one
    vec_id are vectors of their own and link like any other. Null ids never name a component
    that has others. An empty table gives no rows; other columns are ignored.
    """
    vector = F.transform(F.col(embedding), lambda x: x.cast("double"))
    kept = F.col(embedding) if table.schema[embedding].dataType.elementType.typeName() == "float" else vector
    sound = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = materialise(
        table.select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.when(F.col(label).isNotNull() & F.coalesce(sound, F.lit(False)), kept).alias("embedding"),
            F.col(label).cast("string").alias("label"),
        ).withColumn("class", F.when(F.col("embedding").isNotNull(), F.sha2(F.concat_ws(",", F.lit("v"), F.col("label"), F.to_json("embedding")), 256))),
        "vectors",
    )
    alone = rows.filter("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"), F.first("label").alias("label")
    )
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    per_label = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, per_label) / BUCKET))))
    vectors = F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    codes = materialise(classes.select(vectors, "weight", "node", "label").mapInArrow(_encoder(bits, seed, threshold), CODES), "codes")
    placed = _placed(codes)
    opened = materialise(_grouped(placed).mapInArrow(_opened(threshold, bits), placed.schema), "open")
    found = _grouped(opened.join(classes.select("node", "embedding"), "node")).mapInArrow(_linked(threshold, bits), "node bigint, links bigint, root bigint")
    found = materialise(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    groups = classes.select("class", "node", "least", "weight").join(links, "node", "left").join(parts, "node", "left")
    groups = groups.withColumn("component", F.coalesce("component", "node"))
    named = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = groups.join(named, "component").select("class", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = join_groups(rows.filter("class is not null").select("vec_id", "class"), materialise(groups, "groups"), "class", "weight").drop("class", "weight")
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
