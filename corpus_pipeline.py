"""The training-corpus pipeline: toxicity, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each result as Parquet to the shared
folder and reads it again. All stages but the last return the columns of documents, so extra columns pass through. Rows with a null
doc_id or text go through every stage like others; an empty table passes through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colsmith.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from colsmith.llm.common import materialize
from colsmith.llm.queries import table, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The stages before have left little of an executor's memory, so the tokenizer takes less text at once and keeps fewer pieces.
    return packing.pack_documents(docs, tokenizer_path(), batch_chars=500_000, most_pieces=150_000)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the string kernel, SimHash or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
