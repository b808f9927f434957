"""One query an operator, over its whole tables, with the columns that each contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colsmith.llm import decontaminate, exact_dedup, lm_score, packing, pii, simhash, substring_dedup, token_counts, token_files, toxicity
from colsmith.session import new_path


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "text_hash")


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op7_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-orc")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.token_index(spark, path)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing_decontamination": op1_winnowing_decontamination,
    "op2_cross_entropy_difference": op2_cross_entropy_difference,
    "op3_pii_crf": op3_pii_crf,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_trie_token_counts": op5_trie_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity_string_kernel": op7_toxicity_string_kernel,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_token_orc": op9_token_orc,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_winnowing_decontamination": decontaminate.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
