"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenfold.llm import adaptive_rules, chat, decontaminate, dense_search, disclosure, katz, oracles, packing, pairwise_quality, secret_scan, sketch_dedup, token_files, trie_counts, turn_repair
from evenfold.llm.common import documents, remainder_of_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


@registered("op6_suffix_array_decontamination", oracles.LEAKS)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@registered("op10_adaptive_quality_rules", oracles.quality_rules(adaptive_rules.RULES, adaptive_rules.LEAST_GROUP, adaptive_rules.SYMBOLS))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@registered("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = token_files.new_folder(docs, "tokens")
    token_files.write(docs, path, tokenizer_file("byte_bpe_50k.json"))
    rows = token_files.digests(token_files.read(spark, path, "doc_id", "n_tokens", "ids"))
    return token_files.with_starts(rows, token_files.read(spark, path, "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


@registered("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


@registered("op4_pairwise_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder_of_id(F.col("doc_id"), 3) == 1
    model = pairwise_quality.fit(docs, labels, ~held_out)
    return pairwise_quality.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


@registered("op8_similarity_sketch_dedup", oracles.NEAR)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_duplicates(documents(spark, sf_dir), shingle=4).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@registered("op3_disclosure_sanitisation")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.spans(documents(spark, sf_dir))
    counts = [F.size(F.filter(F.col("base.kind"), lambda k: k == F.lit(disclosure.KINDS.index(name)))).cast("long").alias(f"n_{name}") for name in disclosure.KINDS[:4]]
    return found.select(
        F.col("k").alias("doc_id"), *counts, F.sha2(disclosure.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        disclosure.listed(disclosure.all_spans()).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


@registered("op2_snapshot_collapse", oracles.CHAT)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapsed(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@registered("op7_trie_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


@registered("op1_katz_backoff")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return katz.scored(docs, remainder_of_id(F.col("doc_id"), 5) != 1).select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@registered("op13_trigram_secret_scan", oracles.secret_spans(secret_scan.RULES, len(secret_scan.BASE)))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans, n = secret_scan.scan(documents(spark, sf_dir)), F.col("spans"), len(secret_scan.BASE)
    counts = [F.size(secret_scan.of_kinds(spans, i, i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)]
    base = F.sha2(secret_scan.listed(secret_scan.of_kinds(spans, 0, n - 1)).cast("binary"), 256)
    return found.select(F.col("key").alias("doc_id"), *counts, base.alias("base_sha256"), secret_scan.listed(spans).alias("spans"))


@registered("op11_dense_blas_search", oracles.SEARCH)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


@registered("op12_interval_turn_repair", oracles.REPAIR)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole, pieces = turn_repair.repaired(turn_repair.damaged(conversations))
    ids = conversations.select(F.col("conv_id")).distinct()
    found = ids.join(whole.drop("edits"), F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    texts = turn_repair.digests(pieces, whole)
    found = found.join(texts, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("numbers"), zero).alias("gaps"), *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
