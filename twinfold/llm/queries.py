"""One query per operator over its whole table; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import chat_format, context_mixing, grouping_packer, hard_negatives, int8_dedup, one_bit_search, periodic_runs, ppm_language
from twinfold.llm import simhash_blocks, simple8b, token_counts, toxic_segments, trie_bpe
from twinfold.llm.common import fold, table

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2
SEQUENCE = 1024
LONG_DOCUMENT = 4096  # tokens


def op1_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return context_mixing.score(table(spark, folder, "documents"), fold(F.col("doc_id"), 5, 1))


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return int8_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    files = simple8b.write_ids(docs, public_tokenizers.path(WORD_BPE), END_ID)
    return simple8b.read_ids(spark, files, digest=True)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold(F.col("doc_id"), 4, 2))
    model = toxic_segments.learn(docs.where(~F.col("held_out")), table(spark, folder, "labels"))
    scored = docs.select("doc_id", "held_out", toxic_segments.toxicity(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxic_segments.THRESHOLD).cast("int"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold(F.col("doc_id"), 4, 2))
    trees = ppm_language.learn(docs.where(~F.col("held_out")))
    return docs.select("doc_id", "held_out", ppm_language.language(docs, trees).alias("p")).select("doc_id", "held_out", "p.*")


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return grouping_packer.pack_documents(
        table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), END_ID, SEQUENCE
    )


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return one_bit_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_blocks.near_duplicates(table(spark, folder, "documents"))


def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return trie_bpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """With one conversation more, whose texts hold the template's control strings."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(more)))


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counts = token_counts.learn(docs, public_tokenizers.path(PIECE_BPE))
    counted = docs.select("doc_id", token_counts.token_counts(docs, counts).alias("c")).select("doc_id", "c.*")
    return counted.withColumn("over_limit", F.col("n_tokens") > LONG_DOCUMENT)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every seventh id are moved on by one."""
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of about every tenth text the last words become a repetition of the first of them."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    # Only the chosen texts are cut into words.
    marked = marked.withColumn("g", F.expr("h div 10")).withColumn("words", F.when(F.expr("h % 10 = 0"), words))
    n = F.size("words").cast("long")
    marked = marked.withColumn("a", F.when(n > 0, F.col("g") % n))
    marked = marked.withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))))
    tail = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    ))
    return marked.select("doc_id", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, folder, "documents"))
    found = docs.select("doc_id", periodic_runs.periodic_runs(docs).alias("r")).select("doc_id", "r.*")
    # The greatest length / period, compared as whole numbers; of equal ones the first.
    top = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("top", top)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_context_mixing, op2_embedding_near_dedup, op3_token_files, op4_toxicity, op5_language_id, op6_best_fit_packing, op7_nearest_neighbours, op8_simhash_near_dedup, op9_bpe_round_trip, op10_chat_formatting,
        op11_token_counts, op12_hard_negatives, op13_periodic_runs,
    )
}
