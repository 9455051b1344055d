"""Conversation structure repair: a dynamic programme over the turns that a repair retains.

A repaired conversation is an optional system turn and then user and assistant turns in
alternation, or nothing. Its turns are retained ones, kept or given another role, and inserted
ones. What lies between two retained turns follows from them: the turns between are deleted, at
the difference of two prefix sums of deletions, and the pair of roles says how many turns have to
be inserted. So a turn's cost to go is its own price and the least, over later turns, of gap and
cost to go; one running minimum for each role of the earlier turn gives it without looking at all
later turns. Of equally cheap repairs the one whose audit is least in ASCII order is chosen: D
before I before K before R, so the later next turn, then more inserts, then keeping.

Audits need only roles and faults of turns, a byte each; texts take no part. Conversations are
streamed in order out of sorted partitions, once as these bytes and once, behind their audit, with
their texts, so a task never holds a conversation's texts. A conversation's turns are in one task,
as its text and digest are made in order; beside the turn at hand, that task holds 25 bytes a turn.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

_WHITE = "\t\n\x0b\x0c\r "
USER, ASSISTANT = "user", "assistant"
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5  #: what edits cost, and an undeleted truncated turn besides
#: Faults of a turn: none, truncated, and those that must be deleted.
CLEAN, TRUNCATED, DUPLICATE, BLANK = range(4)
#: The states of a repair are the last role: nothing yet, system, user, assistant; OTHER is what a turn can't stay.
START, S, U, A, OTHER = range(5)
#: Turns to be inserted between the roles of neighbours, and between the last role and the end; a pair that isn't here can't be.
INSERTS = {(START, S): 0, (START, U): 0, (START, A): 1, (S, U): 0, (S, A): 1, (U, A): 0, (U, U): 1, (A, U): 0, (A, A): 1}
AT_END = {START: 0, S: 2, U: 1, A: 0}
#: Pairs of neighbours in a conversation that are legal.
LEGAL = {(S, U), (U, A), (A, U)}
#: Audits of short conversations that a worker remembers.
REMEMBERED, SHORT = 100_000, 64


def _walk(turns: bytes, first: tuple[int, int], next_at: list[array], next_to: list[bytearray]) -> str:
    """The audit of the path that begins at the retained turn first (place, role)."""
    out, i, q, (j, r) = [], 0, START, first
    while j <= len(turns):
        out.append("D" * (j - 1 - i) + "I" * INSERTS[q, r] + ("K" if turns[j - 1] >> 2 == r else "R"))
        i, q, j, r = j, r, next_at[r][j], next_to[r][j]
    out.append("D" * (len(turns) - i) + "I" * AT_END[q])
    return "".join(out)


def audit(turns: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns, each given as its role's state * 4 + its fault."""
    n = len(turns)
    # The least cost from a role on, with the prefix sum of deletions up to that place in it; at first, all that follows is deleted
    least = [DELETE * n + INSERT * AT_END[q] for q in range(4)]
    at, to = [n + 1] * 4, [OTHER] * 4
    next_at, next_to = [array("q", bytes(8 * (n + 1))) for _ in range(4)], [bytearray(n + 1) for _ in range(4)]
    for j in range(n, 0, -1):
        role, fault = divmod(turns[j - 1], 4)
        if fault >= DUPLICATE:
            continue
        retained = []
        for r in (S, U, A):
            if r == role or r != S:
                next_at[r][j], next_to[r][j] = at[r], to[r]
                # the two prefix sums, before this turn and behind it, differ by one deletion
                retained.append((r, "K" if r == role else "R", RETYPE * (r != role) + CUT_OFF * (fault == TRUNCATED) + least[r] - DELETE))
        for q in range(4):
            found = min(((price + INSERT * INSERTS[q, r], -INSERTS[q, r], letter, r) for r, letter, price in retained if (q, r) in INSERTS), default=None)
            if found and found[0] < least[q]:  # of equals the later turn stays, as its audit has a D where this one's hasn't
                least[q], at[q], to[q] = found[0], j, found[3]
    return least[START], _walk(turns, (at[START], to[START]), next_at, next_to)


_remembered = lru_cache(REMEMBERED)(audit)


def repaired_turns(letters: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every retained or inserted turn: user and assistant alternate, behind a system turn if one is kept."""
    expected = USER
    for x in letters:
        role, text = (expected, "") if x == "I" else next(turns)
        if x == "D":
            continue
        if x == "R":
            role = expected
        yield x, role, text
        if not role.startswith("s"):
            expected = ASSISTANT if expected == USER else USER


def _prepared(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Nulls as one space, and what turns are ordered by besides their number."""
    clean = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _faults(rows: DataFrame, named: DataFrame | None) -> DataFrame:
    """conv_id, turn, role's state * 4 + the turn's first fault: all that the plan needs of rows. A conversation that is only named has a row without code."""
    shown = F.rtrim(F.col("text"), F.lit(_WHITE))
    blank, cut = shown == "", ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    state = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    narrow = rows.select("conv_id", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut"), state.alias("state"))
    if named is not None:  # before rows are dealt: a union of what is dealt already need not bring partitions together
        narrow = narrow.unionByName(named.select("conv_id", *[F.lit(None).cast(t).alias(x) for x, t in narrow.dtypes[1:]]))
    # rows are dealt by conversation once; the window by text and the order by turn are both made within its partitions
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    dealt = narrow.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(CLEAN)
    return dealt.select("conv_id", "turn", "role", "digest", (F.col("state") * 4 + fault).alias("code"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows: Iterator[tuple], schema: pa.Schema, many: int = 1024, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most so many rows and about so many characters."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= many or chars >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_PLAN = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(conv: int | None, rows: Iterator[tuple]) -> tuple:
        codes, first, last, distinct = bytearray(), None, None, 0
        for _, turn, code in rows:
            if code is not None:
                codes.append(code)
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
        faults = [sum(c & 3 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = sum((a >> 2, b >> 2) not in LEGAL for a, b in zip(codes, codes[1:]))
        gaps = last - first + 1 - distinct if distinct else 0
        return conv, gaps, *faults, illegal, *(_remembered if len(codes) <= SHORT else audit)(bytes(codes))

    yield from _batched((of(*group) for group in groupby(_streamed(batches), key=itemgetter(0))), _PLAN)


def plans(turns: DataFrame, conversations: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What is wrong with every conversation, and its cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Turns are ordered by turn, nulls first, then role and text, so ties have a place. gaps are the
    numbers missing between the least and the largest turn; each turn's first fault counts (blank,
    a duplicate of an earlier turn, truncated); illegal are neighbours whose roles can't follow each
    other. Null roles and texts are one space; rows without conv_id are one conversation, that
    without. conversations (conv_id) names conversations to be reported though they have no rows:
    zeros and an empty audit. An empty table gives no rows; other columns are ignored.
    """
    return _plans_of(_prepared(turns, conv_id, turn, role, text), conversations, conv_id)


def _plans_of(rows: DataFrame, conversations: DataFrame | None, conv_id: str) -> DataFrame:
    named = None if conversations is None else conversations.select(F.col(conv_id).cast("long").alias("conv_id")).distinct()
    ordered = _faults(rows, named).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "turn", "code")
    return ordered.mapInArrow(_plans, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _behind_audits(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """audit, conv_id, role, text: the turns of each conversation in order, behind a row that has its audit."""
    heads = planned.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    both = rows.withColumn("audit", F.lit(None).cast("string")).unionByName(heads).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "audit", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]]]]:
    for conv, rows in groupby(_streamed(batches), key=itemgetter(0)):
        letters = next(rows)[1]
        yield conv, repaired_turns(letters, ((r[2], r[3]) for r in rows))


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of all conversations once repaired: conv_id, place (from 1), role, text, edit (K kept, R under a new role, I inserted); input as in plans()."""
    rows = _prepared(turns, conv_id, turn, role, text)
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(((conv, k, r, t, x) for conv, lines in _conversations(batches) for k, (x, r, t) in enumerate(lines, 1)), schema)

    return _behind_audits(rows, _plans_of(rows, None, conv_id)).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def report(turns: DataFrame, conversations: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """plans() with repaired_sha256 besides: the digest of the repaired turns as role:text, joined by newlines; texts are hashed as they stream."""
    rows = _prepared(turns, conv_id, turn, role, text)
    planned = materialise(_plans_of(rows, conversations, conv_id), "audits")
    schema = pa.schema([("id", pa.int64()), ("repaired_sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, lines in _conversations(batches):
            hashed = hashlib.sha256()
            for k, (_, r, t) in enumerate(lines):
                hashed.update(f"{chr(10) * (k > 0)}{r}:{t}".encode())
            yield conv, hashed.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(digests(batches), schema)

    found = _behind_audits(rows, planned).mapInArrow(run, "id long, repaired_sha256 string")
    return planned.join(found, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
