"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from snippetry.llm import (
    chat, decontamination, embedding_copies, fill_in_middle, hard_negatives, jaccard_join, language_id, line_dedup, mixing,
    quality_classifier, quality_rules, repeated_bytes, sql_text, token_files,
)
from snippetry.llm.common import table
from snippetry.session import stage

TOKENIZER = "word_bpe_49k.json"


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    index = decontamination.build_index(table(spark, folder, "documents"))
    found = decontamination.matches(index, table(spark, folder, "benchmark"), window=10)
    judged = decontamination.contamination(index, stage(found, "benchmark-matches"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    formatted = stage(chat.format_turns(given.unionByName(extra)), "chat")
    return chat.conversation_digests(chat.read_turns(formatted))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), by_words=True)
    read = token_files.starts(stage(token_files.read_all(files), "token-rows"))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = language_id.train(documents.where(~language_id.held_out(F.col("doc_id"))))
    predicted = language_id.predict(documents.select("doc_id", "text"), model)
    model.drop()
    return predicted.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, folder, "pages"))
    return cleaned.select(
        "page_id", "host", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = jaccard_join.components(table(spark, folder, "documents"), shingle=3, percent=90)
    return joined.select("doc_id", "n_shingles", "component_id")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held = language_id.held_out(F.col("doc_id"), fold=3, rest=1)
    features = quality_classifier.featured(table(spark, folder, "documents"))
    rows = stage(quality_classifier.with_trust(features, table(spark, folder, "labels"), ~held), "quality-features")
    scored = quality_classifier.fit(rows).scored(rows)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    removed = repeated_bytes.remove_repeated(table(spark, folder, "documents"), length=400)
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = hard_negatives.quantised(table(spark, folder, "embeddings"), scale=256, label=moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=10, low=30, high=90)


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    formed = fill_in_middle.transform(table(spark, folder, "documents").select("doc_id", "text"), seed="1", plain_percent=10, spm_percent=20)
    read = fill_in_middle.restored(formed.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return read.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_embedding_copies(spark: SparkSession, folder: str) -> DataFrame:
    linked = embedding_copies.components(table(spark, folder, "embeddings"), threshold=0.93)
    return linked.select("vec_id", "n_links", "component_id", "kept")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_chat_formatting, op3_quality_rules, op4_token_files, op5_language_id, op6_line_dedup,
        op7_ngram_jaccard_join, op8_quality_classifier, op9_mixing, op10_repeated_bytes, op11_hard_negatives, op12_fill_in_middle, op13_embedding_copies,
        pipeline,
    )
}

LLM_ORACLES = {
    "op1_benchmark_decontamination": sql_text.DECONTAMINATION,
    "op2_chat_formatting": sql_text.CHAT,
    "op3_quality_rules": sql_text.QUALITY_RULES,
    "op6_line_dedup": sql_text.LINE_DEDUP,
    "op7_ngram_jaccard_join": sql_text.JACCARD,
    "op11_hard_negatives": sql_text.HARD_NEGATIVES,
    "op12_fill_in_middle": sql_text.FILL_IN_MIDDLE,
    "op13_embedding_copies": sql_text.EMBEDDING_COPIES,
}
