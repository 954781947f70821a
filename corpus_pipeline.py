"""A corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, best-fit packing.

A stage is a function of (spark, docs, sf_dir); each but the last returns the columns of documents, and
what it returns is written as Parquet before the next reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import langid, ngram_join, packing, suffix_dedup
from basalt.llm._common import cleared, discard, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with too little certainty go, as do those without a letter."""
    model = langid.fit_languages(docs)
    return langid.predict_languages(docs, model).where(~F.col("rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by three quarters of their five-word shingles that of the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of 50 bytes that an earlier document has go; n_chars follows."""
    cut = suffix_dedup.remove_repeats(docs, 50, keep_text=True, keep=[c for c in docs.columns if c != "text"])
    removed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(removed, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, end_id=2)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("best_fit_packing", best_fit_packing)]
#: The stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages wrote on the way is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with cleared(spark, kept := []):
            docs = written(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
