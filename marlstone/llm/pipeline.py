"""The stages of the corpus pipeline, from documents to tokens: toxicity, exact dedup, SimHash near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of documents. A stage begins with letting go of what the ones before it left on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, mixing, sentencepiece_bpe, simhash, toxicity
from marlstone.llm.common import let_go, materialise, table, text_of
from marlstone.llm.queries import MODEL, digested, domain_of_source, weights

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, verdicts: DataFrame, keyed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs less the rows that verdicts (doc_id, key, part, kept) reject; of several rows kept of one part, in all columns, the one with the longest text.

    Verdicts are for rows: keyed gives rows the key that tells apart those of one id. An id that
    only one row has needs none, so only rows without id or with a repeated one are keyed. Of
    ids, only rejected and repeated ones are joined: Spark broadcasts them if they are few, else
    it shuffles.
    """
    ids = verdicts.filter("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1")
    ids = materialise(ids.select(F.col("doc_id").alias("_id"), F.col("n").alias("_n")), "verdicts")
    again, unnamed = ids.filter("_n > 1").select("_id"), docs.filter("doc_id is null")
    once = docs.filter("doc_id is not null").join(ids, F.col("doc_id") == F.col("_id"), "left_anti")
    if again.isEmpty() and unnamed.isEmpty():
        return once

    def shared(rows: DataFrame) -> DataFrame:
        return rows.join(again, F.col("doc_id") == F.col("_id"), "left_semi").unionByName(rows.filter("doc_id is null"))

    row = F.max(F.struct(F.char_length(F.coalesce("text", F.lit(""))).alias("_chars"), *docs.columns)).alias("_row")
    rows = keyed(shared(docs)).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(row)
    kept = shared(verdicts.filter("kept")).select("doc_id", "key", "part").distinct()
    best = rows.join(kept, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))).groupBy("part").agg(F.max("_row").alias("_row"))
    return once.unionByName(best.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it learns from the labelled ones among docs."""
    let_go(spark)
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    let_go(spark)
    verdicts = exact_dedup.exact_dedup(docs).select("doc_id", F.col("text_sha256").alias("key"), F.col("text_sha256").alias("part"), "kept")
    text = F.regexp_replace(text_of(), "[\\x20\\x09-\\x0D]+", "")
    return _without(docs.select(*COLUMNS), verdicts, lambda rows: rows.withColumn("key", F.sha2(text, 256)))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    let_go(spark)
    verdicts = simhash.simhash_groups(docs).select("doc_id", F.col("fp").alias("key"), F.col("component").alias("part"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return _without(docs.select(*COLUMNS), verdicts, lambda rows: simhash.with_fingerprints(rows).withColumnRenamed("fp", "key"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them; a document that is taken in several epochs is a row for each."""
    let_go(spark)
    mixed = mixing.mix(docs.select(*COLUMNS), weights(spark), domain_of_source())
    return mixed.filter("mix_copies > 0").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests for every row."""
    let_go(spark)
    return digested(sentencepiece_bpe.encode_decode(docs, public_tokenizers.path(MODEL)), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A trained classifier, XXH64 fingerprints and BPE have no SQL; each stage is held against a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
