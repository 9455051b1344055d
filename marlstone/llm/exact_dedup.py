"""Exact dedup against a minimal perfect hash over the distinct digests of history.

The distinct digests of history are dealt to shards of bounded size. Each shard is a minimal
perfect hash built by levels: a digest takes the position its level's hash gives unless another
digest wants the same, in which case both go to the next level; the rank of a position among
all taken ones is its slot. Slots hold the full digest and the winner's locator, so a lookup
compares all 32 bytes and a stranger that falls on a slot is recognised. Incoming digests that
are members join their slot's group, the others form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import join_groups, materialise, text_of

#: Distinct digests of history and of incoming rows together that a shard has on average.
SHARD_DIGESTS = 16384
#: Positions for each digest at a level; after MAX_LEVELS levels, what is left is held in sorted order.
GAMMA, MAX_LEVELS = 1.5, 48
INDEX_SCHEMA = "shard int, sizes array<int>, taken binary, rest binary, digests binary, keep_ids binary, keep_nulls binary, chars binary, counts binary"
GROUP_SCHEMA = "digest binary, keep_id bigint, keep_null boolean, chars int, group_size bigint, member boolean"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """doc_id, chars (code points of the original text), digest (SHA-256 of the text without [\\x20\\x09-\\x0D]); null text counts as empty."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.char_length(text_of(text)).alias("chars"),
        F.unhex(F.sha2(F.regexp_replace(text_of(text), "[\\x20\\x09-\\x0D]+", ""), 256)).alias("digest"),
        *more,
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest with its winner: most code points, then smallest doc_id; a null doc_id wins only where no other has as many."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i")))
    return rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("group_size")).select(
        "digest", F.col("b.i").alias("keep_id"), (-F.col("b.c")).alias("chars"), "group_size"
    )


def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the digests (n x 4 words) for each level."""
    with np.errstate(over="ignore"):
        h = words[:, level % 4] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def build(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, taken positions of all levels (bool), digests left over (sorted rows), and the slot of each of the distinct digests."""
    n = len(words)
    left, sizes, bits, where, offset = np.arange(n), [], [], np.full(n, -1, "i8"), 0
    while left.size and len(sizes) < MAX_LEVELS:
        size = max(64, int(GAMMA * left.size))
        at = (_mix(words[left], len(sizes)) % np.uint64(size)).astype("i8")
        count = np.bincount(at, minlength=size)
        alone = count[at] == 1
        where[left[alone]] = offset + at[alone]
        bits.append(count == 1)
        sizes.append(size)
        offset += size
        left = left[~alone]
    taken = np.concatenate(bits) if bits else np.zeros(0, bool)
    slots = (np.cumsum(taken) - 1)[np.maximum(where, 0)] if taken.size else np.zeros(n, "i8")
    left = left[np.lexsort(words[left].T[::-1])] if left.size else left
    slots[left] = taken.sum() + np.arange(left.size)
    return sizes, taken, words[left], slots


def find(words: np.ndarray, sizes: list[int], taken: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 where it can't be a member. Whether it is one only the slot's digest can tell."""
    out, left, offset, rank = np.full(len(words), -1, "i8"), np.arange(len(words)), 0, np.cumsum(taken) - 1
    for level, size in enumerate(sizes):
        if not left.size:
            return out
        at = offset + (_mix(words[left], level) % np.uint64(size)).astype("i8")
        hit = taken[at]
        out[left[hit]] = rank[at[hit]]
        left, offset = left[~hit], offset + size
    known = {r.tobytes(): int(taken.sum()) + i for i, r in enumerate(rest)}
    for i in left if known else ():
        out[i] = known.get(words[i].tobytes(), -1)
    return out


def _words(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u8").reshape(-1, 4)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    sizes, taken, rest, slots = build(words)
    by = np.argsort(slots)
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "sizes": [sizes],
            "taken": [np.packbits(taken).tobytes()],
            "rest": [rest.tobytes()],
            "digests": [words[by].tobytes()],
            "keep_ids": [pdf["keep_id"].to_numpy("i8")[by].tobytes()],
            "keep_nulls": [pdf["keep_null"].to_numpy("?")[by].tobytes()],
            "chars": [pdf["chars"].to_numpy("i8")[by].tobytes()],
            "counts": [pdf["group_size"].to_numpy("i8")[by].tobytes()],
        }
    )


def _lookup_shard(incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The groups of one shard: history's, with members of incoming joined to them, then incoming's nonmembers."""
    words = _words(incoming["digest"]) if len(incoming) else np.zeros((0, 4), "<u8")
    new = {k: incoming[k].to_numpy(t) for k, t in (("keep_id", "i8"), ("keep_null", "?"), ("chars", "i8"), ("group_size", "i8"))}
    held, old = np.zeros((0, 4), "<u8"), {k: v[:0] for k, v in new.items()}
    member = np.zeros(len(words), bool)
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        taken = np.unpackbits(np.frombuffer(row["taken"], "u1"))[: sum(row["sizes"])].astype(bool)
        old = {k: np.frombuffer(row[c], t).copy() for k, c, t in (("keep_id", "keep_ids", "i8"), ("keep_null", "keep_nulls", "?"), ("chars", "chars", "i8"), ("group_size", "counts", "i8"))}
        slots = find(words, list(row["sizes"]), taken, np.frombuffer(row["rest"], "<u8").reshape(-1, 4))
        member = (slots >= 0) & (held[slots] == words).all(axis=1)
        s = slots[member]
        mine, theirs = {k: v[member] for k, v in new.items()}, {k: v[s] for k, v in old.items()}
        old["group_size"][s] += mine["group_size"]
        more, same = mine["chars"] > theirs["chars"], mine["chars"] == theirs["chars"]
        first = ~mine["keep_null"] & (theirs["keep_null"] | (mine["keep_id"] < theirs["keep_id"]))
        better = more | same & first
        for k in ("keep_id", "keep_null", "chars"):
            old[k][s[better]] = mine[k][better]
    digest = np.concatenate([held, words[~member]]).tobytes()
    out = {k: np.concatenate([old[k], new[k][~member]]) for k in new}
    return pd.DataFrame({"digest": [digest[i : i + 32] for i in range(0, len(digest), 32)], **out, "member": np.arange(len(out["chars"])) < len(held)})


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"),
        "digest",
        F.coalesce("keep_id", F.lit(0)).alias("keep_id"),
        F.col("keep_id").isNull().alias("keep_null"),
        "chars",
        "group_size",
    )


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard from history's groups (digest, keep_id, chars, group_size); distinct digests spread evenly, whatever the texts' skew."""
    return _sharded(history, shards).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def lookup(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups of history and incoming together; member is false for those of which history has no digest."""
    return _sharded(incoming, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_lookup_shard, GROUP_SCHEMA)


def exact_dedup(docs: DataFrame, is_history: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's group: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    is_history says which rows are history (a condition on docs' columns; default: a half by
    hash of the id); the result doesn't depend on it. Null text counts as empty; empty texts are
    equal to each other and to blank ones. Ties: most code points in the original text, then
    smallest doc_id, nulls last. Rows repeated under one doc_id all carry kept = true. An empty
    table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    old = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(2)) == 0 if is_history is None else is_history
    rows = materialise(digests(docs, doc_id, text, F.coalesce(old, F.lit(False)).alias("old")), "digests")
    history = materialise(grouped(rows.filter("old")), "history")
    incoming = materialise(grouped(rows.filter("not old")), "incoming")
    # a shard's index and the digests looked up in it are in one task, so both are counted
    shards = max(1, -(-(history.count() + incoming.count()) // SHARD_DIGESTS))
    index = materialise(build_index(history, shards), "index")
    groups = materialise(lookup(incoming, index, shards), "groups")
    return join_groups(rows.drop("chars"), groups.select("digest", F.when(~F.col("keep_null"), F.col("keep_id")).alias("keep_id"), "group_size", "member"), "digest", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )
