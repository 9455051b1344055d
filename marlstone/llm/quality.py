"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output, numpy SGD.

A document's features are its words and pairs of neighbouring words, and the 3- and 4-grams of
characters within words and their borders, hashed to rows of an embedding; nothing but its hash
decides a feature's row. Their mean goes through a softmax layer. Both are learned together on the driver from a bounded labelled sample. As the layer is linear, scoring
needs one number per row: the row's part in the difference of the two outputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import held, text_of
from marlstone.llm.labelled import held_out, sample

#: Labelled rows learned from at most; rows of each half of the embedding (words, n-grams); its width.
MAX_SAMPLE, BUCKETS, WIDTH = 6000, 1 << 17, 16
GRAMS = (3, 4)
EPOCHS, RATE, SEED = 5, 20.0, 7
#: Code points after which the next white space ends what is taken at once of a text.
PIECE = 1 << 20
THRESHOLD = 0.3
#: Features of documents that training keeps from one epoch to the next, 8 bytes each; those of the others are made anew.
KEPT = 20_000_000
_WHITE = "\t\n\x0b\x0c\r "
_SPACE = re.compile(f"[{_WHITE}]")
_SPACES = np.array([9, 10, 11, 12, 13, 32], "u4")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)


_POWERS = np.cumprod(np.full(64, 0x100000001B3, "u8"))


def _word_hash(word: str) -> np.ndarray:
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    return (points * _POWERS[np.arange(len(points)) & 63]).sum(keepdims=True)


def features(text: str, before: str = "") -> np.ndarray:
    """Rows of the embedding for every word, pair of words and n-gram of a text, repeats included; none for a blank one.

    before is the word in front of a text that is a piece of a longer one; it adds the pair with the first word.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = np.isin(points, _SPACES)
    keep = ~space | np.append(True, ~space[:-1])
    points, space = np.append(np.append(32, points[keep]), 32).astype("u8"), np.append(np.append(True, space[keep]), True)
    begin = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not begin.size:
        return np.zeros(0, "i8")
    points = np.where(space, np.uint64(32), points)
    word = np.cumsum(np.isin(np.arange(len(points)), begin, assume_unique=True)) - 1
    inside = ~space
    at = (np.arange(len(points)) - begin[np.maximum(word, 0)]) & 63
    hashes = np.add.reduceat(np.where(inside, points * _POWERS[at], 0), begin)
    left = np.append(_word_hash(before), hashes[:-1]) if before else hashes[:-1]
    right = hashes if before else hashes[1:]
    out = [_mix(hashes), _mix(left * np.uint64(0x9E3779B97F4A7C15) + right)]
    for n in GRAMS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h, ok = np.zeros(m, "u8"), np.ones(m, bool)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + m]
            if 0 < i < n - 1:
                ok &= ~space[i : i + m]
        out.append(_mix(h[ok] + np.uint64(n)) + np.uint64(BUCKETS))
    return np.concatenate(out).astype("i8")


def document_features(text: str) -> Iterator[np.ndarray]:
    """features() of a text, piece by piece; pieces end at white space, so that together they are what the whole text gives."""
    at, before = 0, ""
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        piece = text[at:end]
        yield features(piece, before)
        piece = piece.rstrip(_WHITE)
        at, before = end, piece[max(map(piece.rfind, _WHITE)) + 1 :] or before


@dataclass
class QualityModel:
    rows: np.ndarray  #: what each row of the embedding adds to the difference of the outputs
    bias: float

    def score(self, text: str) -> float:
        """The softmax probability of label 1; a text without features has the bias alone."""
        total, n = 0.0, 0
        for ids in document_features(text):
            total, n = total + float(self.rows[ids].sum(dtype="f8")), n + len(ids)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias, -700, 700))))


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a text's features, and the share of each in them."""
    ids, counts = np.unique(np.concatenate([np.zeros(0, "i8"), *document_features(text)]), return_counts=True)
    return ids.astype("i4"), (counts / max(counts.sum(), 1)).astype("f4")


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Plain SGD, one document a step, in a seeded order; without both labels the model gives their share."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (2 * BUCKETS, WIDTH)).astype("f4")
    out, bias = np.zeros((2, WIDTH), "f4"), np.zeros(2, "f4")
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias[1] = np.log(share / (1 - share))
    if len(set(labels.tolist())) == 2:
        done, steps, kept, room = 0, epochs * len(texts), {}, KEPT
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                ids, share_of = kept[i] if i in kept else _counted(texts[i])
                if i not in kept and len(ids) <= room:
                    kept[i], room = (ids, share_of), room - len(ids)
                lr = rate * (1 - done / steps)
                done += 1
                if not ids.size:
                    continue
                mean = share_of @ embed[ids]
                logits = out @ mean + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = p @ out
                out -= lr * 0.05 * np.outer(p, mean)
                bias -= lr * 0.001 * p
                embed[ids] -= lr * np.outer(share_of, back)
    diff = out[1] - out[0]
    return QualityModel((embed @ diff).astype("f4"), float(bias[1] - bias[0]))


def score_texts(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id and score; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.rows, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = held(("quality", hash((shared.value[0].tobytes(), shared.value[1]))), lambda: QualityModel(*shared.value))
        for batch in batches:
            scores = np.fromiter((here.score(t.as_py()) for t in batch.column(1)), "f8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Every row's doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= THRESHOLD).

    Learns from at most max_sample labelled rows that aren't held out. Null and empty texts get
    the model's score for no features; a table without labels gives every row the same score; an
    empty table gives no rows. Labels, ids and other columns play no part in a score.
    """
    model = train(*sample(docs, labels, label, max_sample))
    return score_texts(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
