"""SimHash near-dedup by an index of fingerprints in Gray order.

Two fingerprints within k bits of each other agree on all of at least BLOCKS - k of BLOCKS
blocks, so every pair meets in a group that shares the bits of such a choice of blocks. Inside
a group, fingerprints are sorted by Gray rank, in which neighbours differ little, and FANOUT at
a time are joined into nodes. A node holds the bits on which all below it agree, less those that
nodes above it hold already; a search adds up the differences on its way down and leaves a whole
group as soon as they exceed k.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import connected_components, join_groups, local_components, materialise, text_of

WORDS, MAX_DIFFERENCE, SEED = 3, 2, 42
#: Blocks of 16 bits: for two differing bits, 6 choices of 2 blocks, so groups share 32 bits.
BLOCKS = 4
FANOUT = 8
#: Pairs of a query and a node that a search holds at once.
FRONTIER = 1 << 20
#: Codes whose links are looked for at once.
QUERIES = 1 << 15
#: Shingles that are hashed before their bits are counted.
CHUNK = 1 << 16
#: Fingerprints from which on a group is split again.
LARGE = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each 1 if it is set in over half the XXH64 hashes of text's shingles; 0 for a text without words.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are words joined by
    spaces, repeats included; a text with fewer words than a shingle is one shingle.
    """
    raw = text.encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return 0
    joined = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), "i8", len(raw)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(raw)) - 1
    starts, ends = starts[: len(raw) - k].tolist(), ends[k:].tolist()
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, "i8")
    for i in range(0, len(starts), CHUNK):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])), "<u8", min(CHUNK, len(starts) - i))
        count += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), "<u8", batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view("<i8"))], ["doc_id", "fp"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order in which neighbours differ by one bit."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Trees over the groups of an array of codes; starts gives where groups begin, codes of a group must be in Gray order."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        self.levels = [(FULL * np.ones(len(codes), "u8"), codes)]  # bits that all below agree on, and their values
        self.first: list[np.ndarray] = []  # at each level from 1 up, the first child of each node, and the end
        starts = np.asarray(starts, "i8")
        while len(starts) < len(self.levels[-1][1]):
            n = len(self.levels[-1][1])
            sizes = np.diff(np.append(starts, n))
            nodes = -(-sizes // FANOUT)
            node_starts = np.concatenate([[0], np.cumsum(nodes)[:-1]])
            first = np.repeat(starts, nodes) + FANOUT * (np.arange(nodes.sum()) - np.repeat(node_starts, nodes))
            mask, value = self.levels[-1]
            ones, any_ = np.bitwise_and.reduceat(value & mask, first), np.bitwise_or.reduceat(value & mask, first)
            same = np.bitwise_and.reduceat(mask, first) & ~(ones ^ any_)
            self.levels.append((same, ones & same))
            self.first.append(np.append(first, n))
            starts = node_starts
        self.roots = starts
        above = [np.zeros(len(self.levels[-1][0]), "u8")]
        for level in range(len(self.levels) - 1, 0, -1):
            above.append(np.repeat(self.levels[level][0], np.diff(self.first[level - 1])))
        self.own = [mask & ~up for (mask, _), up in zip(self.levels, above[::-1])]

    def search(self, queries: np.ndarray, trees: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of a query, index of a code of its tree) that differ in most bits or fewer."""
        found_q, found_c = [], []
        top = len(self.levels) - 1
        step = max(1, FRONTIER // FANOUT // 8)
        work = [(top, np.arange(i, min(i + step, len(queries))), trees[i : i + step], np.zeros(min(step, len(queries) - i), "u1")) for i in range(0, len(queries), step)]
        while work:
            level, q, node, seen = work.pop()
            seen = seen + np.bitwise_count((queries[q] ^ self.levels[level][1][node]) & self.own[level][node])
            ok = seen <= most
            q, node, seen = q[ok], node[ok], seen[ok]
            if not level:
                found_q.append(q)
                found_c.append(node)
                continue
            first, counts = self.first[level - 1][node], np.diff(self.first[level - 1])[node]
            for i in range(0, len(q), FRONTIER // FANOUT):
                c = counts[i : i + FRONTIER // FANOUT]
                within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                work.append((level - 1, np.repeat(q[i : i + len(c)], c), np.repeat(first[i : i + len(c)], c) + within, np.repeat(seen[i : i + len(c)], c)))
        none = np.zeros(0, "i8")
        return (np.concatenate(found_q), np.concatenate(found_c)) if found_q else (none, none)


def _links(keys: list[np.ndarray], codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, representative) that connect whatever is within most bits, in whole groups sorted by key, then Gray rank."""
    new = np.ones(len(codes), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    tree = np.cumsum(new) - 1
    index, low = GrayIndex(codes, starts), np.arange(len(codes))
    for i in range(0, len(codes), QUERIES):  # a code has up to 2081 neighbours within two bits, so links aren't held for all
        q, c = index.search(codes[i : i + QUERIES], tree[i : i + QUERIES], most)
        later = q + i > c
        low = local_components(len(codes), low[q[later] + i], low[c[later]])[low]
    moved = np.flatnonzero(low != np.arange(len(codes)))
    return codes[moved], codes[low[moved]]


def _link_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (choice, key, rank, fp) sorted by choice, key, rank: whole groups are taken as they end, so a batch and a group are all that is held."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(4)]
        if not len(now[0]):
            continue
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        end = int(np.argmax(last))
        goes_on = not end and held and all(held[-1][k][-1] == now[k][0] for k in (0, 1))
        if not goes_on:
            done = [*held, [x[:end] for x in now]]
            held = []
            if sum(len(x[0]) for x in done):
                yield _link_batch([np.concatenate(x) for x in zip(*done)], most)
        held.append([x[end:] for x in now])
    if held:
        yield _link_batch([np.concatenate(x) for x in zip(*held)], most)


def _link_batch(rows: list[np.ndarray], most: int) -> pa.RecordBatch:
    a, b = _links(rows[:2], rows[3].view("u8"), most)
    return pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], ["src", "dst"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(most: int, blocks: list[int]) -> list[int]:
    """Masks of all choices of the blocks (masks themselves) but most of them."""
    return [_signed(sum(chosen)) for chosen in combinations(blocks, len(blocks) - most)]


def _block_masks(width: int, start: int = 0, end: int = 64) -> list[int]:
    return [((1 << width) - 1) << at for at in range(start, end, width)]


def fingerprint_links(fps: DataFrame, most: int = MAX_DIFFERENCE) -> DataFrame:
    """Links (src, dst) that connect all distinct fingerprints fp within most bits; of a group in which many are, no more links than fingerprints.

    A group of many fingerprints is split again: those of it that are within most bits agree on
    all but most of the blocks that halve the ones left, too.
    """
    width = 64 // BLOCKS
    wide = _block_masks(width)
    masks = _masks(most, wide)
    choices = lambda masks, first: F.explode(F.array(*[F.struct(F.lit(first + i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", choices(masks, 0).alias("g")).select("g.choice", "g.key", "fp")
    sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("n"))
    # one row for each, and never more than the rows of all choices / LARGE; Spark broadcasts them if they are few
    large = materialise(sizes.filter(F.col("n") > LARGE).select("choice", "key"), "large")
    if not large.isEmpty():
        again, first = None, len(masks)
        for i, m in enumerate(masks):
            rest = [half for b in wide if not b & (m & (1 << 64) - 1) for half in _block_masks(width // 2, b.bit_length() - width, b.bit_length())]
            finer = [_signed((m & (1 << 64) - 1) | (x & (1 << 64) - 1)) for x in _masks(most, rest)]
            part = rows.filter(F.col("choice") == i).join(large, ["choice", "key"], "left_semi").select("fp", choices(finer, first).alias("g")).select("g.choice", "g.key", "fp")
            again, first = part if again is None else again.unionByName(part), first + len(finer)
        rows = rows.join(large, ["choice", "key"], "left_anti").unionByName(again)
    for i, shift in enumerate((1, 2, 4, 8, 16, 32)):
        last = F.col(f"r{i}") if i else F.col("fp")
        rows = rows.withColumn(f"r{i + 1}", last.bitwiseXOR(F.shiftrightunsigned(last, shift)))
    # as unsigned order: flip the sign bit
    rows = rows.select("choice", "key", F.col("r6").bitwiseXOR(F.lit(-(1 << 63))).alias("rank"), "fp")
    return (
        rows.repartition("choice", "key")
        .sortWithinPartitions("choice", "key", "rank")
        .mapInArrow(lambda it: _link_groups(it, most), "src bigint, dst bigint")
    )


def with_fingerprints(rows: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """rows with the fingerprint of their text in fp, null text counting as empty."""
    place, names = rows.columns.index(text), [*rows.columns, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py() or "", words) for t in batch.column(place)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view("<i8"))], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MAX_DIFFERENCE) -> DataFrame:
    """Every row's doc_id, fp, component (a fingerprint of it), component_id and group_size, as in simhash_dedup; component tells apart groups of one component_id."""
    if most >= BLOCKS:
        raise ValueError(f"at most {BLOCKS - 1} differing bits")
    prints = materialise(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(lambda it: _fingerprints(it, words), "doc_id bigint, fp bigint"), "prints"
    )
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    parts = connected_components(fingerprint_links(distinct.select("fp"), most)).select(F.col("node").alias("fp"), "component")
    groups = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = groups.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    groups = materialise(groups.select("fp", "n", "component").join(named, "component"), "groups")
    return join_groups(prints, groups, "fp", "n").select("doc_id", "fp", "component", "component_id", "group_size")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, most: int = MAX_DIFFERENCE) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of most bits or fewer), group_size, kept.

    Null text counts as empty; texts without words have fingerprint zero and are linked like any
    other. Equal fingerprints link. Null doc_ids belong to the component but never name it
    unless all its ids are null. Rows repeated under one doc_id all carry kept = true if it
    names the component. An empty table gives no rows; other columns are ignored.
    """
    return simhash_groups(docs, doc_id, text, words, most).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
