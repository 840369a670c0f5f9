"""From raw documents to token ids: quality, near duplicates, benchmark passages, private data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the cluster's shared folder
and read back as the next stage's docs. All but the last return the columns of documents.

Null and empty texts fail the base rule of the first stage; given to a later one they are linked with nothing, hit nothing, stay as
they are and have no ids. Repeated rows and ties are treated as the operators' docstrings say, very long texts whole; an empty table
gives an empty one. Other columns, also of names that an operator uses inside, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, jaccard_join, pseudonyms, quality, tiktoken_codec
from helixframe.llm.common import fresh, saved, small_batches
from helixframe.llm.queries import pseudonym_key

#: EM has no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the weighed rules reject."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies: 5-word shingles, similarity of 0.8 or more."""
    small_batches(spark, 4 << 20)
    return jaccard_join.keep_one(docs, k=5, threshold=jaccard_join.Threshold(4, 5), subspaces="singles")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace private values by pseudonyms; n_chars follows where an address changes its length."""
    before = fresh(docs, "before")
    out = pseudonyms.pseudonymise(docs.withColumn(before, F.length("text")), pseudonym_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.col("n_chars") + F.length("text") - F.col(before), F.col("n_chars")))
    return out.drop(before)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the digest of what they decode to."""
    small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    ids = docs.select(*own, tiktoken_codec.encode_ids(F.col("text"), path, pattern).alias("ids"))
    return ids.select("*", F.size("ids").cast("long").alias("n_tokens"), tiktoken_codec.decoded_sha256(F.col("ids"), path, pattern).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("private_data", private_data), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
