"""Importance resampling, M-tree search and conversation repair against slow versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import importance, mtree, queries, repair

EXTRA = ("row", "part", "chunk", "rank", "number", "weight", "score", "tree", "home", "query", "audit", "code", "digest", "place", "fate", "copy", "id")


def with_extra(df, *own):
    for x in EXTRA:
        if x not in own:
            df = df.withColumn(x, F.lit("x"))
    return df


# importance resampling


def slow_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def slow_buckets(text, buckets=10_000):
    w = slow_words(text)
    runs = [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]
    return Counter(zlib.crc32(x.encode()) % buckets for x in runs)


def slow_resampled(docs, target, share=25, least=20):
    found = [slow_buckets(t) for _, t in docs]
    s, t = sum(found, Counter()), sum((slow_buckets(x) for x in target), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for (id_, text), f in zip(docs, found):
        n = sum(f.values())
        weight = sum(gain[b] * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        rows.append((id_, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(slow_words(text)) >= least))
    ranked = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = share * len(ranked) // 100
    return sorted(((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(ranked)), key=str) + [(*r[:4], None) for r in rows if not r[4]]


TEXTS = [
    "", None, " .,;\t\n", "A", "aB ab AB", "é̂ ü 中 😀 x", "w" * 300 + " v", ("z" * 49 + " ") * 3, "a\x00b\x7fc 0:9;A", "éa" * 40 + "-" + "b" * 70,
    " ".join(f"w{i % 7}" for i in range(50)), " ".join(f"w{i % 7}" for i in range(50)),
]


@pytest.mark.parametrize("size", [1 << 22, 7, 64])
def test_features_are_the_slow_ones(size):
    for texts in (TEXTS, TEXTS[3:9], ["", None], []):
        got = [Counter() for _ in texts]
        words = Counter()
        column = pa.array([None, *((t or "").encode() for t in texts)], pa.binary())[1:]
        for text, bucket, word in importance.features(column, size):
            for t, b in zip(text.tolist(), bucket.tolist()):
                got[t][b] += 1
            words.update(word.tolist())
        assert got == [slow_buckets(t) for t in texts]
        assert [words[i] for i in range(len(texts))] == [len(slow_words(t)) for t in texts]


@pytest.mark.parametrize("small", [False, True])
def test_resampling_is_the_slow_one(spark, monkeypatch, small):
    if small:  # a chunk ends with each document, counts are added up, and every chunk has a salt of its own
        monkeypatch.setattr(importance, "FULL", 1)
        monkeypatch.setattr(importance, "AT_ONCE", 1)
        monkeypatch.setattr(importance, "SALT_CHUNKS", 1)
    rng = random.Random(5)
    some = [" ".join(rng.choice(["the", "of", "Ä", "x1", "cat", "dog", "tree"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = [(i if i % 9 else None, t) for i, t in enumerate([*TEXTS, *some, "the " * 5000])] + [(5, some[0]), (5, some[0]), (-3, some[1])]
    target = ["the cat of the tree", None, "", "Ä x1 " * 30]
    frame = with_extra(spark.createDataFrame(docs, "doc_id long, text string"))
    wanted = with_extra(spark.createDataFrame([(t,) for t in target], "text string"))
    got = [tuple(r) for r in importance.resample(frame, wanted).collect()]
    assert sorted(got, key=str) == sorted(slow_resampled(docs, target), key=str)


def test_resampling_of_nothing(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resample(frame.filter("false"), frame).count() == 0
    got = {r.doc_id: r for r in importance.resample(frame, frame.filter("false"), least_words=0, share=50).collect()}
    assert (got[1].n_features, got[2].n_features, got[2].weight) == (3, 0, 0) and sorted(str(r.rank) for r in got.values()) == ["1", "None"]


# M-trees


def slow_top(rows, k=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(kept) if a != b and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal"])
def test_a_tree_finds_what_brute_force_finds(kind):
    rng = np.random.default_rng(3)
    n = 700
    x = {"spread": rng.integers(-90, 90, (n, 6)), "clusters": rng.integers(-90, 90, (7, 6))[rng.integers(0, 7, n)] * 5 + rng.integers(-3, 3, (n, 6)), "equal": np.full((n, 6), 7)}[kind].astype("f8")
    ids, m = rng.permutation(n).astype("<i8") % 300, float((x * x).sum(1).max())
    order, apart, nodes = mtree.build(x, m)
    assert sorted(order.tolist()) == list(range(n)) and nodes["last"][nodes["leaf"] == 1].max() == n
    tree = mtree.MTree(6, m, ids[order].tobytes(), x[order].astype("<i2").tobytes(), apart.tobytes(), nodes.tobytes())
    for i in range(0, n, 29):
        q = tree.x[i]
        scores = tree.x @ q
        want = sorted((-int(s), int(j)) for r, (s, j) in enumerate(zip(scores, tree.ids)) if r != i)[:5]
        assert tree.search(q, 5, own=i) == [(-s, j) for s, j in want]
        least = -want[2][0]
        assert tree.search(q, 5, float(least), own=i) == [(-s, j) for s, j in want if -s >= least]
    # balls hold what is below them, and distances are those of the vectors
    lifted = np.column_stack([tree.x, np.sqrt(np.maximum(0, m - (tree.x**2).sum(1)))])
    for node in nodes:
        if node["leaf"]:
            away = np.sqrt(((lifted[node["first"] : node["last"]] - lifted[node["row"]]) ** 2).sum(1))
            assert (away <= node["radius"] + 1e-6).all() and np.allclose(away, tree.apart[node["first"] : node["last"]], atol=1e-5)


def test_few_vectors_of_a_far_tree_are_looked_at(monkeypatch):
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 250
    x = np.rint(centres[np.repeat(np.arange(8), 500)] + rng.integers(-4, 5, (4000, 8)))
    m = float((x * x).sum(1).max())
    order, apart, nodes = mtree.build(x, m)
    tree = mtree.MTree(8, m, np.arange(4000, dtype="<i8").tobytes(), x[order].astype("<i2").tobytes(), apart.tobytes(), nodes.tobytes())
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, rows):
            if isinstance(rows, np.ndarray):
                looked.append(len(rows))
            return np.asarray(super().__getitem__(rows))

    tree.x = tree.x.view(Counted)
    found = tree.search(np.asarray(x[0]), 5)
    assert len(found) == 5 and sum(looked) < 2000


@pytest.mark.parametrize("size", [4096, 9])
def test_top_k_is_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(mtree, "TREE", size)
    monkeypatch.setattr(mtree, "BALLS", 3)
    monkeypatch.setattr(mtree, "PAGE", 4)
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.5, -0.25, 0.125, 0.0, 1.0, -0.001]) for _ in range(4)]) for i in range(260)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (400, None), (450, [0.1, None, 0.2, 0.3]), (500, [float("nan"), 0.0, 0.0, 0.0]), (550, [float("inf"), 0.0, 0.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (600, [0.5, 0.5]), (601, [0.5, -0.5]), (650, [1.0]), (700, []), (701, []), (750, [0.0] * 4), (-50, [100.0, 0.0, 0.0, 0.0])]
    df = with_extra(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = mtree.top_k(df, F.col("vec_id") % 50 == 0)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == slow_top(as_float)
    assert mtree.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError, match="too long"):
        mtree.top_k(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"), F.lit(True))


# repair of conversations


def slow_repair(turns):
    """Cheapest (cost, audit) by trying every edit in every place, shortest paths over (turns done, last role)."""
    best = {(0, ""): (0, "")}
    ends = None
    for i in range(len(turns) + 1):
        for _ in range(3):  # inserts lead on within a place
            for (at, last), (cost, audit) in list(best.items()):
                if at == i:
                    for role in "ua":
                        if role == ("a" if last == "u" else "u"):
                            new = (cost + 5, audit + "I")
                            best[i, role] = min(best.get((i, role), new), new)
        for (at, last), (cost, audit) in list(best.items()):
            if at != i:
                continue
            if i == len(turns):
                if last in ("", "a"):
                    ends = min(ends or (cost, audit), (cost, audit))
                continue
            role, text, bad, cut = turns[i]
            ways = [(last, cost + 2, "D")]
            if not bad:
                follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
                ways += [(r, cost + 5 * cut + (r != role), "K" if r == role else "R") for r in follows if r == role or r in "ua"]
            for r, c, x in ways:
                new = (c, audit + x)
                best[i + 1, r] = min(best.get((i + 1, r), new), new)
    return ends


def as_bytes(turns):
    state = {"s": repair.S, "u": repair.U, "a": repair.A}
    return bytes(state.get(r, repair.OTHER) * 4 + (repair.BLANK if bad else repair.TRUNCATED if cut else repair.CLEAN) for r, _, bad, cut in turns)


def test_audits_are_the_cheapest_and_least():
    rng = random.Random(7)
    kinds = [(r, "", bad, cut) for r in "suax" for bad, cut in ((False, False), (False, True), (True, False))]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert repair.audit(as_bytes(turns)) == slow_repair(turns), turns
    for _ in range(1500):
        turns = [rng.choice(kinds if rng.random() < 0.5 else kinds[:9:3]) for _ in range(rng.randrange(4, 14))]
        assert repair.audit(as_bytes(turns)) == slow_repair(turns), turns


def slow_report(rows):
    """What report() has of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns, faults = set(), [], Counter()
    for _, role, text in rows:
        shown = text.strip("\x20\t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        turns.append((role[:1], text, fault in ("blank", "duplicate"), fault == "truncated"))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit = slow_repair(turns)
    lines, last, it = [], "", iter(rows)
    for x in audit:
        row = next(it) if x != "I" else None
        if x != "D":
            role = row[1] if x == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{row[2] if row else ''}")
            last = role[:1]
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


CONVERSATIONS = {
    1: [(0, "system", "Be good."), (1, "user", "Hi?"), (2, "assistant", "Yes."), (2, "assistant", "Yes."), (5, "user", "And\t"), (6, "assistant", "")],
    2: [(None, "user", "Who?"), (None, "user", "Who?"), (0, None, None), (1, "umpire", "Out!"), (2, "", "x.")],
    3: [(None, "assistant", "\x0b\x0c \r\n")],
    4: [(3, "system", "S."), (7, "system", "T."), (8, "assistant", "A."), (8, "tool", "中 😀!\n"), (9, "User", "No.")],
    None: [(1, "user", "Lost."), (2, "assistant", "Found.  ")],
    6: [(i, ("user", "assistant")[i % 2], f"word {i % 50}." * (1 + 400 * (i == 7))) for i in range(600)],
}


def test_reports_and_repaired_turns(spark):
    rows = [(c, *r) for c, turns in CONVERSATIONS.items() for r in turns]
    df = with_extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    named = spark.createDataFrame([(c,) for c in [*CONVERSATIONS, 99, 99]], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(df, named).collect()}
    want = {c: slow_report(turns) for c, turns in CONVERSATIONS.items()} | {99: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got == want
    lines = {}
    for r in repair.repair(df).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(lines[r.conv_id]) and r.edit in "KRI"
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in CONVERSATIONS} == {c: w[-1] for c, w in want.items() if c != 99}
    plain = {r.conv_id: tuple(r)[1:] for r in repair.plans(df).collect()}
    assert plain == {c: w[:-1] for c, w in want.items() if c != 99}
    assert repair.report(df.filter("false")).count() == 0 and repair.repair(df.filter("false")).count() == 0


def test_damage(spark):
    rows = [(i, t, "assistant", "One. Two! Three?") for i in range(40) for t in (0, 1, None)] + [(None, 0, None, None)]
    got = Counter(tuple(r) for r in queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if fate:
            want[(c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)] += 1 + (fate == 3)
    assert got == want
