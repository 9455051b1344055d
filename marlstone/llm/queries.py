"""The queries of this subpackage's operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import chat, embedding_dedup, exact_dedup, importance, mixing, mtree, oracles, quality, repair, sentencepiece_bpe, simhash, toxicity, url_filter, warc
from marlstone.llm.common import table

MODEL = "piece_bpe_32k.model"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("in_history")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


#: The query's tree: sources by number to four domains; weights of nodes without a row are 1.
DOMAINS = ("web", "books", "code", "forum")
WEIGHTS = (
    ("web", None, None, 50.0), ("books", None, None, 20.0), ("code", None, None, 20.0), ("forum", None, None, 10.0),
    ("web", "en", None, 6.0), ("web", "de", None, 2.0), ("books", "en", None, 3.0), ("code", "en", None, 9.0),
    ("web", "en", "src0", 2.0), ("forum", "en", "src15", 4.0),
)


def domain_of_source() -> Column:
    """A source's domain, by its number."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), F.pmod(F.floor(number / 5).cast("int"), F.lit(len(DOMAINS))) + 1)


def weights(spark: SparkSession) -> DataFrame:
    quoted = lambda x: "cast(null as string)" if x is None else f"'{x}'"
    rows = ", ".join(f"({', '.join(map(quoted, w[:3]))}, {w[3]}D)" for w in WEIGHTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(domain, lang, source, weight)")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights(spark), domain_of_source())
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


#: What both turns of conversation -1 say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(chat.format_conversations(turns))
    loss = F.array_join("losses", "")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def digested(encoded: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of encoded documents (doc_id, ids, decoded)."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL)))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures: fetched on a day of 2024 and at a second of it that follow from the id."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod("page_id", F.lit(366)) * 86400 + F.pmod(F.col("page_id") * 7919, F.lit(86400)))
    return table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a part of the pages' own keys, by the first digits of a key's MD5: added on one day, removed and added again later for some."""
    keys = pages.select(F.explode(url_filter.url_keys(F.col("url"))).alias("key")).distinct()
    number = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    dated = keys.withColumn("n", number).filter("n % 5 = 0").withColumn("first", F.pmod(F.floor(F.col("n") / 5), F.lit(200)))
    entry = lambda action, after: F.struct(F.lit(action).alias("action"), day(F.col("first") + after).alias("at"))
    history = F.when(F.col("n") % 3 == 0, F.array(entry("add", 0))).when(F.col("n") % 3 == 1, F.array(entry("add", 0), entry("remove", 90))).otherwise(
        F.array(entry("add", 0), entry("remove", 45), entry("add", 120))
    )
    return dated.select(F.when(F.col("n") % 2 == 0, "malware").otherwise("adult").alias("list"), "key", F.explode(history).alias("e")).select("list", "key", "e.action", "e.at")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(captures(spark, sf_dir), list_entries(table(spark, sf_dir, "pages")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations as op13 is to find them: by crc32 of conv_id:turn, a twentieth of the rows each is dropped, emptied, without its stops, there twice, or a user's."""
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.report(damaged(turns), turns)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm import pipeline as stages

    return stages.run(spark, sf_dir)


def queries() -> dict:
    own = (
        op1_exact_dedup, op2_warc, op3_embedding_near_dedup, op4_simhash_near_dedup, op5_mixing,
        op6_chat, op7_quality, op8_toxicity, op9_sentencepiece, op10_url_filters, op11_importance_resampling, op12_top_k_search, op13_structure_repair, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql(WEIGHTS, DOMAINS, mixing.MAX_EPOCHS, mixing.SEED)
