"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.llm import chat, decontaminate, hard_negatives, host_rules, jaccard_join, ngram_lm, packing, periodic_runs, quality_fm, secrets, segment_search, token_counts, warc
from skiff.llm.common import remainder, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanner() -> secrets.Scanner:
    return secrets.train(secrets.labelled_findings(), public_tokenizers.path("word_bpe_49k.json"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), scanner())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    rows = warc.payload_figures(warc.read_warc(spark, path))
    return rows.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs, remainder("doc_id", 7) != 2)
    return ngram_lm.score(docs, model).select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, machine).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


#: The contract's own conversation, of control strings only.
CONTROL_TURNS = "SELECT * FROM (VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_TURNS))
    return chat.digests(chat.format_conversations(turns))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.rewritten(table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", noisy), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_warc, op4_decontamination, op5_host_rules, op6_best_fit_packing, op7_trie_lm, op8_quality_fm, op9_chat_format, op10_jaccard_join, op11_topk_search, op12_periodic_runs, op13_hard_negatives)}
ORACLE = {"op3_warc": warc.oracle_sql(), "op5_host_rules": host_rules.oracle_sql(), "op11_topk_search": segment_search.oracle_sql(), "op13_hard_negatives": hard_negatives.oracle_sql(), "op9_chat_format": chat.oracle_sql(CONTROL_TURNS.replace("L,", ","))}
