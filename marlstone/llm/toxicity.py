"""Toxicity by compression distance: window lengths under a dictionary of ordinary text and one of toxic text.

Zstandard trains one dictionary on whole ordinary texts and one on whole toxic texts. A window
is a word with the space before it (longer words are several windows that overlap); what it
takes less under the toxic dictionary than under the ordinary one is its saving. Toxic texts
are mostly ordinary prose, so training goes on: windows of each half of the toxic texts that
the dictionaries of the other half single out are what the next toxic dictionary is trained
on, and windows of ordinary texts that they single out wrongly are what the ordinary dictionary
is trained on besides. A document's evidence is the sum of what its windows save beyond a floor.
Floor and threshold, and how many rounds there are, are calibrated on labelled documents that
no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import give_back, held, text_of
from marlstone.llm.labelled import held_out, sample

#: Labelled rows learned from at most; of these, every CALIBRATION-th calibrates and trains no dictionary.
MAX_SAMPLE, CALIBRATION = 10_000, 5
#: Bytes of a window at most and between the windows of a longer word, so that whatever has up to 24 bytes is whole in one.
WINDOW, STEP = 48, 24
#: Bytes of the dictionaries trained on whole texts, and of those trained on windows.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_WINDOWS, TOXIC_WINDOWS = 262_144, 32_768, 16_384, 4_096
#: Segment lengths with which dictionaries are trained on texts and on windows.
TEXT_SEGMENT, WINDOW_SEGMENT = 64, 16
#: Windows are singled out from the saving on that toxic documents reach so many times as often as ordinary ones.
RATIO = 4.0
ROUNDS = 2
#: Put behind each window so that its compressed form is never given up as too little gain.
PAD = b" " + b"~" * 32
#: Put behind a dictionary, as zstandard doesn't index a dictionary's last bytes.
FILLER = b"\n" * 16
#: Windows whose savings a worker keeps.
KEPT = 200_000
FLOORS, CUTS = range(8), range(1, 16)
THRESHOLD = 0.5


def normal(text: str) -> bytes:
    """Lower case in UTF-8, white space runs as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").split())


def windows(data: bytes) -> list[bytes]:
    """The distinct words of a normal text in order, those longer than WINDOW in overlapping pieces."""
    words = list(dict.fromkeys(data.split()))
    if max(map(len, words), default=0) <= WINDOW:
        return words
    return list(dict.fromkeys(w[i : i + WINDOW] for w in words for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        5, window_log=20, hash_log=17, chain_log=17, search_log=5, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=0, write_dict_id=0, write_checksum=0,
    )
    content = zstandard.ZstdCompressionDict(dictionary + FILLER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=content)


def train_dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary that zstandard trains; the end of the joined samples where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8 if segment >= TEXT_SEGMENT else 6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    floor: int = 0  #: bytes that a window's saving must exceed to count
    threshold: float = 0.5  #: evidence from which on a document is toxic

    def __post_init__(self) -> None:
        self._ordinary, self._toxic, self._kept = compressor(self.ordinary), compressor(self.toxic), {}

    def saving(self, window: bytes) -> int:
        """Bytes that a window takes less under the toxic dictionary than under the ordinary one."""
        known = self._kept.get(window)
        if known is None:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            data = b" " + window + PAD
            known = self._kept[window] = len(self._ordinary.compress(data)) - len(self._toxic.compress(data))
        return known

    def evidence(self, text: str) -> int:
        """What the windows of a text save beyond the floor; 0 where nothing is known of toxic text."""
        if not self.toxic:
            return 0
        saving, floor = self.saving, self.floor
        return sum(s - floor for s in map(saving, windows(normal(text))) if s > floor)

    def score(self, text: str) -> float:
        """0 to 1, 0.5 at the threshold."""
        return float(1 / (1 + np.exp(np.clip(self.threshold - self.evidence(text), -700, 700))))


@dataclass
class _Half:
    """What is known from one half of the fitting documents: samples for the toxic dictionary, and windows for the ordinary one."""

    toxic: list[bytes]
    ordinary: list[bytes]


def _model(base: bytes, halves: list[_Half], first: bool) -> ToxicityModel:
    toxic, ordinary = [x for h in halves for x in h.toxic], [x for h in halves for x in h.ordinary]
    toxic_dictionary = train_dictionary(TOXIC_BYTES, toxic, TEXT_SEGMENT // 2) if first else train_dictionary(TOXIC_WINDOWS, toxic, WINDOW_SEGMENT)
    return ToxicityModel(base + (train_dictionary(ORDINARY_WINDOWS, ordinary, WINDOW_SEGMENT * 2) if ordinary else b""), toxic_dictionary)


class _Documents:
    """The windows of documents by number, so that a model weighs each distinct one once."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        self.own = [np.fromiter((number.setdefault(w, len(number)) for w in windows(x)), "i4") for x in texts]
        self.windows = list(number)

    def savings(self, model: ToxicityModel, which: list[int]) -> list[np.ndarray]:
        """What the windows of some documents save."""
        needed = np.unique(np.concatenate([self.own[i] for i in which]))
        saved = np.zeros(len(self.windows), "i4")
        saved[needed] = np.fromiter((model.saving(self.windows[w]) for w in needed), "i4", len(needed))
        return [saved[self.own[i]] for i in which]


def _singled_out(model: ToxicityModel, docs: _Documents, ordinary: list[int], toxic: list[int], ratio: float) -> _Half:
    """Windows of toxic and of ordinary documents that a model takes for toxic; one that both have is for the side where it is more common."""
    saved = docs.savings(model, ordinary), docs.savings(model, toxic)
    best = [np.array([s.max(initial=-WINDOW) for s in side]) for side in saved]
    least = next((t for t in range(1, WINDOW) if (best[1] >= t).mean() > ratio * ((best[0] >= t).sum() + 0.5) / len(best[0])), WINDOW)
    marked = [[docs.own[i][s >= t] for i, s in zip(side, ss)] for side, ss, t in zip((ordinary, toxic), saved, (max(1, least - 1), least))]
    share = [np.bincount(np.concatenate(m), minlength=len(docs.windows)) / len(m) for m in marked]
    foul = share[1] > ratio * share[0]
    samples = lambda side: [b" " + docs.windows[w] + b" " for ws in marked[side] for w in ws if foul[w] == side]
    return _Half(samples(1), samples(0))


def _calibrate(model: ToxicityModel, savings: list[np.ndarray], y: np.ndarray) -> int:
    """Sets floor and threshold to those with the fewest errors on documents that no dictionary has seen; of equal ones the middle threshold, the lowest floor. The number of errors."""
    fewest = len(y) + 1
    for floor in FLOORS:
        evidence = np.array([np.maximum(0, s - floor).sum() for s in savings])
        errors = np.array([((evidence >= c) != y).sum() for c in CUTS])
        if errors.min() < fewest:
            fewest, best = int(errors.min()), np.flatnonzero(errors == errors.min())
            model.floor, model.threshold = floor, CUTS[best[len(best) // 2]] - 0.5
    return fewest


def train(texts: list[str], labels: np.ndarray) -> ToxicityModel:
    """fit() on texts that aren't normal yet."""
    return fit([normal(t) for t in texts], labels)


def fit(data: list[bytes], labels: np.ndarray) -> ToxicityModel:
    """Dictionaries, floor and threshold from labelled normal texts; without texts of both kinds to fit and to calibrate on, no text has evidence."""
    held, fit = ([i for i in range(len(data)) if (i % CALIBRATION == 0) == side] for side in (True, False))
    if any(len(set(labels[side].tolist())) < 2 for side in (held, fit)):
        return ToxicityModel(b"", b"")
    docs, halves = _Documents(data), [fit[0::2], fit[1::2]]
    sides = [[[i for i in half if labels[i] == y] for y in (0, 1)] for half in halves]
    base = train_dictionary(ORDINARY_BYTES, [data[i] for i in fit if not labels[i]], TEXT_SEGMENT)
    known = [_Half([data[i] for i in toxic], []) for _, toxic in sides]
    chosen, fewest = None, len(held) + 1
    for done in range(ROUNDS + 1):
        model = _model(base, known, not done)
        errors = _calibrate(model, docs.savings(model, held), labels[held])
        if errors < fewest:
            chosen, fewest = model, errors
        if done == ROUNDS or not all(map(all, sides)):
            break
        marked = [_singled_out(_model(base, [known[1 - h]], not done), docs, *sides[h], RATIO) for h in (0, 1)]
        if not all(m.toxic for m in marked):
            break
        known = [_Half(m.toxic, m.ordinary + k.ordinary) for m, k in zip(marked, known)]
    return chosen


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_sample: int = MAX_SAMPLE) -> ToxicityModel:
    """The model of a table's sample; of what the driver held to train it, only the dictionaries stay in memory."""
    model = ToxicityModel(*_parameters(fit(*sample(docs, labels, label, max_sample, form=normal))))
    give_back()
    return model


def _parameters(model: ToxicityModel) -> tuple[bytes, bytes, int, float]:
    return model.ordinary, model.toxic, model.floor, model.threshold


def score_texts(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id and score; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(_parameters(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = held(("toxicity", hash(shared.value)), lambda: ToxicityModel(*shared.value))
        for batch in batches:
            scores = np.fromiter((here.score(t.as_py()) for t in batch.column(1)), "f8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs whose text isn't toxic, in all their columns; one pass, no shuffle. Null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(_parameters(model))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = held(("toxicity", hash(shared.value)), lambda: ToxicityModel(*shared.value))
        for batch in batches:
            texts = batch.column(place)
            yield batch.filter(pa.array([here.score(t.as_py() or "") < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Every row's doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= THRESHOLD).

    Learns from at most max_sample labelled rows that aren't held out. Null and empty texts have
    no evidence and so a low score; without toxic labels every row has the same low score; an
    empty table gives no rows. Labels, ids and other columns play no part in a score.
    """
    model = learned(docs, labels, label, max_sample)
    return score_texts(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
