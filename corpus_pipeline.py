"""Preparation of a training corpus: each stage is a function (spark, docs, sf_dir) -> DataFrame over what the one before kept.

1. language: texts that are null or without a letter, or in no learnt language, go.
2. lines: lines that repeat an earlier line, or (from 20 characters on) differ from one by an edit, are taken out of their texts;
   a text that had lines and has only blank ones left goes, n_chars is that of the new text.
3. near_duplicates: one document of each group of similar texts stays.
4. contamination: documents with passages of the benchmark go.
5. tokens: the texts as byte-level BPE ids; lossless says whether they decode to the text again.

Stages 1 to 4 return the columns of documents, whatever else these hold; null and empty texts pass 2 to 5 unharmed. An empty
table stays one. Rows are told by id and text: rows that repeat both are copies of each other, and so are rows without an id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, line_join, minhash_hamming, ppm_langid, spaced_seeds
from tidewright.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm_langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    had = F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    out = line_join.drop_lines(docs.withColumn("_had_text", had), shortest_copies=1)
    out = out.where(~F.col("_had_text") | (F.length(F.trim(F.translate("text", "\n\r\t", "   "))) > 0)).drop("_had_text")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_hamming.keep_first(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seeds.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, lossless."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("contamination", contamination), ("tokens", tokens)]

#: SQL cannot express language models and byte-pair merges; tests/llm compares with a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
