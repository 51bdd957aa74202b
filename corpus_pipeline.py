"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as
Parquet in the shared folder and hands the reread table to the next. All but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm.mixing import mix
from sealwright.llm.packing import pack
from sealwright.llm.queries import TOXIC_FROM, table, toxicity_model, word_tokenizer
from sealwright.llm.repeats import cut_repeats
from sealwright.llm.scratch import kept
from sealwright.llm.setsketch import near_duplicates
from sealwright.llm.toxicity import score_toxicity

MOST_REPEATS = 1.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score says toxic. The model learns from the labelled documents, as op1's does."""
    model = toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep_rows=True, below=TOXIC_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component, that of smallest id; of equal rows, one."""
    names = docs.columns
    out = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone__")).distinct()
    left = docs.join(out, F.col("doc_id") == F.col("gone__"), "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    return left.dropDuplicates(names) if repeated else left


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 50 bytes that a document of smaller id holds; documents with nothing left go."""
    cut = cut_repeats(docs, with_text=True)
    left = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weighs up small sources, none seen more than MOST_REPEATS times; every document stays at least once."""
    return mix(docs, budget=None, max_repeats=MOST_REPEATS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("source_mix", source_mix),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained model, a tokenizer and packing are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
