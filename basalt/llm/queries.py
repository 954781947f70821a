"""The operators' queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, langid, metric_join, ngram_join, packing, suffix_dedup, token_files, top_k, warc
from ._common import new_path


def tokenizer(name: str) -> str:
    """A vocabulary file, which is never copied into the repository."""
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path, end_id=1)
    return token_files.read_tokens(spark, path, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, end_id=2)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = new_path(spark, "warc")
    files = warc.write_index(warc.write_archives(pages, path), path)
    return warc.read_pages(spark, pages, path, files)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 decodes is what it was given: the part of it that SQL can say."""
    return op6_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def packing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces of op10 stand anywhere but right behind the one before, in their sequence and in their document, or beyond a sequence's end."""
    before = lambda by, order: F.coalesce(F.sum("length").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wrong = (F.col("offset") != before("sequence_id", "offset")) | (F.col("start") != before("doc_id", "piece")) | (F.col("offset") + F.col("length") > 1024)
    return op10_best_fit_packing(spark, sf_dir).select(wrong.alias("wrong")).agg(F.count(F.when(F.col("wrong"), 1)).alias("gaps"))


QUERIES = {
    "op3_suffix_dedup": op3_suffix_dedup,
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op4_exact_top_k": op4_exact_top_k,
    "op7_embedding_near_duplicates": op7_embedding_near_duplicates,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op5_warc": op5_warc,
    "op6_byte_bpe": op6_byte_bpe,
    "op9_language_id": op9_language_id,
    "op8_token_files": op8_token_files,
    "op10_best_fit_packing": op10_best_fit_packing,
    "bpe_round_trip": bpe_round_trip,
    "packing_gaps": packing_gaps,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": ngram_join.ORACLE,
    "op2_chat_perspectives": chat.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_exact_top_k": top_k.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_embedding_near_duplicates": metric_join.ORACLE,
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "packing_gaps": "SELECT 0::BIGINT AS gaps",
}
