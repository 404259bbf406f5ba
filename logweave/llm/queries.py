"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import chat, decontaminate, html, licenses, mixing, oracles, pii, quality, sharding, simhash, tokens
from logweave.llm.frames import table

#: The key of the pseudonyms in the registered query; a deployment passes its own.
PII_KEY = "registered-query"


def vocabulary(name: str) -> str:
    """The place of a public tokeniser's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def quality_vocabularies() -> tuple[str, str]:
    return vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken")


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_shard_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT bigint(-7) AS conv_id, bigint(t) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    return chat.digests(chat.explode_examples(given.unionByName(probe)))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), quality_vocabularies())
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "other_chars_per_token", "token_entropy")


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_pii_feistel, op2_mix_sources, op3_token_counts, op4_shard_splitters, op5_chat_prefix_targets, op6_license_rules, op7_decontaminate, op8_quality_fertility, op9_simhash_ball, op10_html_main_text)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": oracles.MIX, "op4_shard_splitters": oracles.SHARDS, "op5_chat_prefix_targets": oracles.CHAT, "op7_decontaminate": oracles.LEAKS}
