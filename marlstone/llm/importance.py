"""Resampling towards a target corpus by importance weights of hashed words and pairs of words.

Every run of one or two words of a document falls into one of BUCKETS by its crc32. How much
likelier a bucket is in the target than in the corpus is its gain; a document's weight is the mean
gain of its features, and a draw without replacement takes the highest of weight plus noise.

The corpus becomes inverted postings: for each chunk of at most CHUNK documents and each part of
the buckets one row, which has the bucket, document and count of every posting, packed, so that a
bucket that all documents hold has no more rows than any other. Postings are written once, then
dealt by part of the buckets, each part salted by chunk, as a part may be as large as it likes;
what both corpora hold of a part's buckets meets them there, gives its gains, and each row leaves
as one sum for each of its chunk's documents. Sums of a chunk, one row for each part, are added
up, and the draw numbers documents in the order of their scores by ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise
from marlstone.operators.tables import numbered_in_order

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Parts of the buckets; documents of a chunk at most; features after which a chunk ends with its document; those counted at once.
PARTS, CHUNK, FULL, AT_ONCE = 32, 4096, 4_000_000, 2_000_000
#: Bytes of text looked at at once; bytes of a word from which on zlib makes its crc32; chunks of a salt.
WINDOW, LONG_WORD, SALT_CHUNKS = 1 << 22, 48, 64
WIDTH = -(-BUCKETS // PARTS)

_BYTES = np.arange(256, dtype="u1")
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype("u1")
_IN_WORD = (_LOWER >= 128) | ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122))
_CRC = np.arange(256, dtype="u4")
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
_ONES = np.uint32(0xFFFFFFFF)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of words of data, each carried on from a state; both without the last inversion. Words are taken together, a byte of each at a time."""
    order = np.argsort(np.minimum(length, LONG_WORD + 1).astype("u1"), kind="stable")[::-1]
    at, size, c = start[order], length[order], state[order]
    many = int((size > LONG_WORD).sum())
    for i in range(many):
        c[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(c[i] ^ _ONES)) ^ 0xFFFFFFFF
    upto = len(size) - np.searchsorted(size[many:][::-1], np.arange(LONG_WORD), side="right")  # how many are longer than k
    for k in range(LONG_WORD):
        if upto[k] <= many:
            break
        now = c[many : upto[k]]
        c[many : upto[k]] = _CRC[(now ^ data[at[many : upto[k]] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = c
    return out


def _windows(data: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about size bytes that end behind a byte which is in no word, or with a text."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data):
            text = ends[np.searchsorted(ends, end, side="right") - 1] if ends[0] <= end else 0
            gaps = np.flatnonzero(~_IN_WORD[data[at:end]])
            cut = max(int(text), at + int(gaps[-1]) + 1 if gaps.size else 0)
            if cut > at:
                end = cut
                break
            end = min(end + size, len(data))  # one word fills the range
        yield at, end
        at = end


def features(texts: pa.Array, size: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket) of every feature, and the text of every word, of a range of some texts' bytes after the other; places of texts count from 0."""
    offsets = np.frombuffer(texts.buffers()[1], "i4" if texts.type == pa.binary() else "i8")[texts.offset : texts.offset + len(texts) + 1]
    if offsets[0] == offsets[-1]:
        return
    data = np.frombuffer(texts.buffers()[2], "u1")[offsets[0] : offsets[-1]]
    ends = (offsets[1:] - offsets[0]).astype("i8")
    last_text, last = -1, np.zeros(1, "u4")
    for a, b in _windows(data, ends, size):
        piece = _LOWER[data[a:b]]
        inside = _IN_WORD[piece]
        border = np.zeros(b - a + 1, bool)
        border[0] = True
        border[(own := ends[(ends > a) & (ends <= b)]) - a] = True
        begin = np.flatnonzero(inside & (border[:-1] | ~np.append(False, inside[:-1])))
        if not begin.size:
            continue
        length = np.flatnonzero(inside & (border[1:] | ~np.append(inside[1:], False))) + 1 - begin
        text = np.searchsorted(ends, a + begin, side="right")
        words = _crc(piece, begin, length, np.full(len(begin), _ONES))
        before, whose = np.append(last, words[:-1]), np.append(last_text, text[:-1])
        pair = whose == text
        before = before[pair]
        before = _CRC[(before ^ np.uint32(32)) & 0xFF] ^ (before >> np.uint32(8))
        pairs = _crc(piece, begin[pair], length[pair], before)
        last_text, last = text[-1], words[-1:]
        yield np.append(text, text[pair]), ((np.append(words, pairs) ^ _ONES) % np.uint32(BUCKETS)).astype("i8"), text


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, "i8")
    return keys[first], np.add.reduceat(counts[order], first) if keys.size else counts


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view("u1").reshape(len(values), values.itemsize).T).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class _Chunk:
    """Postings of a few documents: keys are place of the bucket * CHUNK + place of the document, where a part's buckets follow each other."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.keys, self.counts, self.new, self.waiting = np.zeros(0, "u4"), np.zeros(0, "i8"), [], 0
        self.words = np.zeros(CHUNK, "i8")

    def add(self, place: np.ndarray, bucket: np.ndarray, word_place: np.ndarray) -> None:
        self.new.append((((bucket % PARTS) * WIDTH + bucket // PARTS) * CHUNK + place).astype("u4"))
        self.waiting += len(place)
        self.words += np.bincount(word_place, minlength=CHUNK)
        if self.waiting > AT_ONCE:
            self.settle()

    def settle(self) -> None:
        new = np.sort(np.concatenate([np.zeros(0, "u4"), *self.new]))
        first = np.flatnonzero(np.append(True, new[1:] != new[:-1])) if new.size else np.zeros(0, "i8")
        keys, counts = new[first], np.diff(np.append(first, len(new)))
        self.keys, self.counts = (keys, counts) if not self.keys.size else _counted(np.append(self.keys, keys), np.append(self.counts, counts))
        self.new, self.waiting = [], 0

    def rows(self, chunk: int) -> Iterator[dict]:
        """One row of the documents (part -1), and one for each part of the buckets."""
        self.settle()
        bucket, place = np.divmod(self.keys, np.uint32(CHUNK))
        n = np.bincount(place, weights=self.counts, minlength=CHUNK).astype("i8")
        many = len(self.ids)
        yield {"chunk": chunk, "part": -1, "ids": self.ids, "features": n[:many].tolist(), "words": self.words[:many].tolist()}
        totals = np.bincount(bucket, weights=self.counts, minlength=WIDTH * PARTS).astype("i8")
        sizes = np.bincount(bucket, minlength=WIDTH * PARTS).astype("u4")
        upto = np.append(0, np.cumsum(sizes.astype("i8")))
        for part in range(PARTS):
            b = slice(part * WIDTH, (part + 1) * WIDTH)
            own = slice(upto[b.start], upto[b.stop])
            yield {
                "chunk": chunk, "part": part, "totals": totals[b].tolist(), "sizes": _packed(sizes[b]),
                "places": _packed(place[own].astype("u2")), "counts": _packed(self.counts[own].astype("u8")),
            }


_POSTINGS = pa.schema([
    ("chunk", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("features", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())),
    ("totals", pa.list_(pa.int64())), ("sizes", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()),
])
_POSTINGS_SQL = "chunk long, part int, ids array<long>, features array<long>, words array<long>, totals array<long>, sizes binary, places binary, counts binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made, now, features_of = TaskContext.get().partitionId() << 32, 0, _Chunk(), 0

    def ended() -> Iterator[pa.RecordBatch]:
        for row in now.rows(task + made):
            yield pa.RecordBatch.from_pylist([row], schema=_POSTINGS)

    for batch in batches:
        at = 0
        while at < batch.num_rows:  # as many rows as the chunk has room for
            take = min(batch.num_rows - at, CHUNK - len(now.ids), 256)
            piece, base = batch.slice(at, take), len(now.ids)
            now.ids += piece.column(0).to_pylist()
            for text, bucket, word in features(piece.column(1)):
                now.add(text + base, bucket, word + base)
                features_of += len(text)
            at += take
            if len(now.ids) == CHUNK or features_of >= FULL:
                yield from ended()
                made, now, features_of = made + 1, _Chunk(), 0
    if now.ids:
        yield from ended()


def postings(docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """The packed postings of a table's texts, rows in any order; null texts have none."""
    id_ = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    return docs.select(id_.alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")).mapInArrow(_index, _POSTINGS_SQL)


def _totals(rows: DataFrame, name: str) -> DataFrame:
    """(part, at, name): what all chunks hold of each bucket."""
    return rows.filter("part >= 0").select("part", F.posexplode("totals").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(part, gains): the gain of each bucket of a part, in order, from both corpora's postings."""
    both = materialise(
        _totals(corpus, "s").join(_totals(target, "t"), ["part", "at"], "left").select("part", "at", "s", F.coalesce("t", F.lit(0)).alias("t")), "totals"
    )
    all_ = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    double = lambda x: F.col(x).cast("double") if isinstance(x, str) else F.lit(float(x))
    odds = (double("t") + 1) * (double(all_["S"] or 0) + buckets) / ((double("s") + 1) * (double(all_["T"] or 0) + buckets))
    gain = F.floor(F.lit(1000.0) * F.log(odds)).alias("gain")
    return both.select("part", F.struct("at", gain).alias("g")).groupBy("part").agg(F.transform(F.sort_array(F.collect_list("g")), lambda g: g.gain).alias("gains"))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            gain = np.repeat(np.array(row["gains"], "i8"), _unpacked(row["sizes"], "u4"))
            sums = np.zeros(CHUNK, "i8")
            np.add.at(sums, _unpacked(row["places"], "u2"), gain * _unpacked(row["counts"], "u8").astype("i8"))
            yield pa.RecordBatch.from_pydict({"chunk": [row["chunk"]], "sums": [_packed(sums)]})


def _weights(rows: pa.Table) -> pa.Table:
    """The documents of a chunk with their weights: a row of them, and one of sums for each part."""
    sums, docs = np.zeros(CHUNK, "i8"), None
    for row in rows.to_pylist():
        if row["sums"] is None:
            docs = row
        else:
            sums += _unpacked(row["sums"], "i8")
    n = np.array(docs["features"], "i8")
    weight = sums[: len(n)] // np.maximum(n, 1)  # towards minus infinity
    return pa.table({"doc_id": pa.array(docs["ids"], pa.int64()), "row": docs["chunk"] * CHUNK + np.arange(len(n)), "n_features": n, "n_words": pa.array(docs["words"], pa.int64()), "weight": weight})


def weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, row (a number of its own for every row), n_features, n_words, weight of every document."""
    corpus = materialise(postings(docs, doc_id, text), "postings")
    part_gains = gains(corpus, postings(target, None, target_text))
    salts = max(1, corpus.filter("part = -1").count() // SALT_CHUNKS)
    salted = corpus.filter("part >= 0").select("part", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt"), "chunk", "sizes", "places", "counts")
    each = part_gains.select("part", "gains", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    met = salted.join(each.hint("shuffle_hash"), ["part", "salt"]).select("chunk", "gains", "sizes", "places", "counts")
    sums = met.mapInArrow(_contributions, "chunk long, sums binary")
    none = lambda t: F.lit(None).cast(t)
    rows = corpus.filter("part = -1").select("chunk", "ids", "features", "words", none("binary").alias("sums"))
    rows = rows.unionByName(sums.select("chunk", none("array<long>").alias("ids"), none("array<long>").alias("features"), none("array<long>").alias("words"), "sums"))
    return rows.groupBy("chunk").applyInArrow(_weights, "doc_id long, row long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from the sha256 of seed and id; a null id is an empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: from 1 in the order of scores for share percent of those with enough words, else null.

    Null texts have no words, so their weight is 0; nor have texts without letters or digits. Rows
    count one by one, under whatever id: ties of score go by doc_id, nulls first, then by row. An
    empty target makes every bucket's gain follow from the corpus alone; an empty corpus gives no
    rows. Other columns are ignored.
    """
    scored = weights(docs, target, doc_id, text, target_text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialise(scored, "scores")
    enough = F.col("n_words") >= least_words
    drawn = share * scored.filter(enough).count() // 100
    ranked = numbered_in_order(scored.filter(enough), F.desc("score"), F.asc_nulls_first("doc_id"), F.col("row"), name="number")
    ranked = ranked.withColumn("rank", F.when(F.col("number") < drawn, F.col("number") + 1)).drop("number")
    out = ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
