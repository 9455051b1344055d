"""SentencePiece BPE encoding by a table of every prefix's last token, and decoding.

The encoding of each prefix of a text ends in exactly one token. An automaton over the
vocabulary gives the tokens that end at a position; the one that is compatible with the last
token of the prefix before it is the prefix's last token, where two tokens are compatible if
merging their joint text gives just these two. The ids are then read off backwards from the end.
No token has white space after another character, and none holds a character without a token of
its own, so a text is cut there first and the parts' encodings are kept in a bounded table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import held, text_of

SPACE = "▁"
#: Words whose ids a worker keeps, in each of two generations; pairs whose compatibility it keeps; tokens whose merges it keeps; a full table starts anew.
MAX_PARTS, MAX_PAIRS, MAX_SPINES = 200_000, 200_000, 20_000
#: Words longer than this aren't kept.
MAX_PART = 13
UNKNOWN_TEXT = " ⁇ "
#: The automaton holds a token and its length in one number.
LENGTH_BITS = 8
LENGTHS = (1 << LENGTH_BITS) - 1


class PieceBpe:
    """A merge-type SentencePiece model with the identity normaliser: encode() and decode() give what the library gives."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i).replace(SPACE, " ") for i in range(size)]
        hidden = {i for i in range(size) if sp.is_control(i)}
        self.hidden, self.unknown = hidden, sp.unk_id()
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        special = hidden | {self.unknown, *self.bytes.values()}
        self.odd_first = special - hidden
        #: what each id stands for
        self.raw = [b"" if i in hidden else UNKNOWN_TEXT.encode() if i == self.unknown else p.encode() for i, p in enumerate(pieces)]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self.pieces, self.sizes = pieces, [len(p) for p in pieces]
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        runs = {p for p in self.ids if len(p) > 1 and not p.strip(" ")}
        words = [p for p in self.ids if p not in runs]
        self.words, self.runs = ({p: sp.get_score(self.ids[p]) for p in x} for x in (words, runs))
        ranks = [self.words[p] for p in words if len(p) > 1]
        if any(" " in p[1:] or len(p) > LENGTHS for p in words) or len(set(ranks)) < len(ranks) or any(x >= min(ranks) for x in self.runs.values()):
            raise ValueError("the vocabulary has white space within tokens, or scores that don't order its merges")
        self.parents = {}  # the two tokens that a token is merged from
        self.automaton = ahocorasick.Automaton()
        for p in words:
            done, last = self.merged(p, self.words)
            if done == [p]:
                self.automaton.add_word(p, self.ids[p] << LENGTH_BITS | len(p))
                if len(p) > 1:
                    self.parents[p] = last
        self.automaton.make_automaton()
        if any(self.words[x] <= self.words[p] for p, two in self.parents.items() for x in two if len(x) > 1):
            raise ValueError("a token is learned before one that it is merged from")
        chars = re.escape("".join(p for p in words if len(p) == 1 and p != " "))
        self.cut = re.compile(f" +[{chars}]*|[{chars}]+|.", re.DOTALL)
        self.plain = re.compile(f"[{chars}]+")
        self.lines = "\n" not in self.words
        self.newline = self._ids(self._unknown("\n")) if self.lines else b""
        self.parts: list[dict[str, bytes]] = [{}, {}]
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[str, float]]] = {}
        self.spaces: dict[int, list[int]] = {}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    @staticmethod
    def merged(text: str, scores: dict[str, float]) -> tuple[list[str], tuple[str, str]]:
        """The pieces of text after merging neighbours, best score first, then leftmost; and the last pair merged."""
        piece, after, before, last = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1)), ("", "")
        heap = [(-scores[text[i : i + 2]], i, text[i : i + 2]) for i in range(len(text) - 1) if text[i : i + 2] in scores]
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            j = after[i] if piece[i] else len(text)
            if j >= len(text) or piece[i] + piece[j] != whole:
                continue
            last = piece[i], piece[j]
            piece[i], piece[j], after[i] = whole, "", after[j]
            if after[i] < len(text):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(text) and piece[a] + piece[b] in scores:
                    heappush(heap, (-scores[piece[a] + piece[b]], a, piece[a] + piece[b]))
        return [p for p in piece if p], last

    def _spine(self, token: int, side: int) -> list[tuple[str, float]]:
        """What stands at one end of a token while it is being merged, in time: each piece and the score at which it goes into the next."""
        if (token, side) not in self.spines:
            if len(self.spines) >= MAX_SPINES:
                self.spines.clear()
            p, out, until = self.pieces[token], [], float("-inf")
            while True:
                out.append((p, until))
                if len(p) == 1:
                    break
                until, p = self.words[p], self.parents[p][side]
            self.spines[token, side] = out[::-1]
        return self.spines[token, side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joint text of two tokens is encoded as these two: no merge across their border comes before those that take its sides away."""
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            score = self.words.get(x + y)
            # of equal scores the leftmost goes first: x's own merge is left of the border's, y's is right of it
            if score is not None and score > until_x and score >= until_y:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if until_x >= until_y and i < len(left) - 1:
                i += 1
            else:
                j += 1

    def prefix_table(self, part: str) -> list[int]:
        """The last token of every non-empty prefix of a part that has no unknown character and white space only in front."""
        last, done, pairs = [-1] * (len(part) + 1), 0, self.pairs
        for end, found in self.automaton.iter(part):
            if end >= done:
                start, token = end + 1 - (found & LENGTHS), found >> LENGTH_BITS
                if start:
                    key = last[start] << 20 | token
                    known = pairs.get(key)
                    if known is None:
                        if len(pairs) >= MAX_PAIRS:
                            pairs.clear()
                        known = pairs[key] = self.compatible(last[start], token)
                    if not known:
                        continue
                done = end + 1
                last[done] = token
        return last

    def _word(self, part: str) -> list[int]:
        last, out, at, sizes = self.prefix_table(part), [], len(part), self.sizes
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def _run(self, n: int) -> list[int]:
        if n not in self.spaces:
            if len(self.spaces) > 1000:
                self.spaces.clear()
            self.spaces[n] = [self.ids[p] for p in self.merged(" " * n, self.runs)[0]]
        return self.spaces[n]

    def _unknown(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def _part(self, part: str) -> list[int]:
        if part[0] != " ":
            return self._word(part) if len(part) > 1 or part in self.ids else self._unknown(part)
        n = len(part) - len(part.lstrip(" "))
        if n < 2:
            return self._word(part)
        # merges of white space score below all others, so they come last and take what words have left
        word = self._word(part[n - 1 :])
        return self._run(n) + word[1:] if self.pieces[word[0]] == " " else self._run(n - 1) + word

    def _parts(self, text: str) -> bytes:
        return self._ids([i for p in self.cut.findall(text) for i in self._part(p)])

    def _new_word(self, word: str) -> bytes:
        """The ids of a space and a word."""
        young, old = self.parts
        out = old.get(word)
        if out is None:
            out = self._ids(self._word(" " + word)) if self.plain.fullmatch(word) else self._parts(" " + word)
        if len(word) <= MAX_PART:
            if len(young) >= MAX_PARTS:
                self.parts = [{}, young]
                self.parts[0][word] = out
            else:
                young[word] = out
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if not self.lines:
            return self._parts(" " + text)
        out, first = [], True
        for line in text.split("\n"):
            if first:
                words = line.split(" ")
            else:
                out.append(self.newline)
                if not line:
                    continue
                if line[0] == " ":
                    words = line[1:].split(" ")
                else:
                    begin, *words = line.split(" ")
                    out.append(self._parts(begin))
            if "" in words:
                out.append(self._parts("".join([" " + w for w in words])))
            else:
                get, new = self.parts[0].get, self._new_word
                out += [get(w) or new(w) for w in words]
            first = False
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: pieces joined, byte tokens read as UTF-8 with U+FFFD for each byte that is none, the space put in front removed."""
        if not self.hidden.isdisjoint(ids):  # they part byte tokens
            runs = [list(run) for hidden, run in groupby(ids, self.hidden.__contains__) if not hidden]
            return "".join([self._text(run, i == 0) for i, run in enumerate(runs)])
        return self._text(ids, True)

    def _text(self, ids: list[int], first: bool) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        if first and raw[:1] == b" " and ids[0] not in self.odd_first:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _utf8(raw)


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


def loaded(model: bytes) -> PieceBpe:
    """The model's tables; made once in each worker."""
    return held(("pieces", hash(model)), lambda: PieceBpe(model))


def read_model(spark: SparkSession, path: str) -> bytes:
    """A model file's bytes, read by Spark, so that any of its stores will do; a path without scheme is tried on the driver first."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode_decode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, ids (array of int, without begin or end) and decoded text.

    Null text counts as empty and has no ids; repeated rows are each encoded. Whole texts are
    taken, however long. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [np.frombuffer(bpe.encode_bytes(t.as_py()), "i4") for t in part.column(1)]
                ends = np.cumsum([0] + [len(x) for x in done]).astype("i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(done)))
                texts = pa.array([bpe.decode(x.tolist()) for x in done], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
