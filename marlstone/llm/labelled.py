"""The labelled rows that classifiers learn from: never a held-out row, and no more rows and bytes than stated."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, text_of

FOLDS = 5
#: Bytes of all texts of a sample at most.
MAX_BYTES = 64 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is held out: crc32 of its id as text is divisible by FOLDS. A null id's text is empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, max_bytes: int = MAX_BYTES, form: Callable[[str], object] = str) -> tuple[list, np.ndarray]:
    """Whole texts and 0/1 labels of at most limit labelled rows that aren't held out, by hash of the id.

    Rows without label or id are passed over; of several labels of one document the largest
    counts, of several texts under one id the smallest. Texts are taken while all of them
    together have max_bytes at most; one that doesn't fit any more is passed over. All of this is decided
    before anything comes to the driver, so neither many rows under one id nor long texts come there. Each text is brought into its form by
    itself, so that besides these only what Spark sent is held, and no other copy of all texts.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    texts = docs.select(F.col("doc_id").alias("id"), text_of().alias("text"))
    order = (F.xxhash64("id"), F.col("id"))
    chosen = known.join(texts.select("id"), "id", "left_semi").orderBy(*order).limit(limit)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = materialise(rows.withColumn("bytes", F.octet_length("text").cast("long")), "sample")
    taken, left = [], max_bytes
    for id_, size in rows.orderBy(*order).select("id", "bytes").collect():
        if size <= left:
            taken.append((id_,))
            left -= size
    fits = docs.sparkSession.createDataFrame(taken, rows.select("id").schema)
    found = rows.join(F.broadcast(fits), "id").select("id", "text", "y").toArrow()
    by_id = np.argsort(found["id"].to_numpy())
    return [form(found["text"][int(i)].as_py()) for i in by_id], found["y"].to_numpy()[by_id]
