"""Stand-in reads and scores from the driver's tables, to run the operators where no sequencing data exist.

They carry no biological meaning. `reads` keeps a document's alphabet letters; `scores` takes an event's value as a
read's score, its user as the subject and its type's alphabetical place as the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient, read_idx, label, seq)"""
    seq = F.upper(F.regexp_replace("text", "[^ACGTMHacgtmh]", ""))
    label = F.when(F.col("source").isin([f"src{i}" for i in range(14, 20)]), -1).otherwise(1)
    return table(spark, sf_dir, "documents").select(F.col("source").alias("patient"), F.col("doc_id").alias("read_idx"), label.alias("label"), seq.alias("seq"))


def short_reads(spark: SparkSession, sf_dir: str, letters: int = 100) -> DataFrame:
    """(patient, read_idx, label, seq): the same letters in reads of at most so many, as a sequencer gives them."""
    r = reads(spark, sf_dir).filter("seq <> ''")
    at = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / letters).cast("int"))
    return r.select("patient", "label", "seq", F.col("read_idx").alias("doc"), F.explode(at).alias("i")).select("patient", (F.col("doc") * 100_000 + F.col("i")).alias("read_idx"), "label", F.substring("seq", F.col("i") * letters + 1, F.lit(letters)).alias("seq"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fold, subject, label, round, read_idx, score); healthy subjects have label 1 and a fold of their own."""
    rounds = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(EVENT_TYPES) for x in (t, i + 1)]), F.col("event_type"))
    label = F.when(F.col("user_id") % 3 == 0, -1).otherwise(1)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("LOO_"), F.col("user_id")).alias("fold"), F.col("user_id").alias("subject"), label.alias("label"), rounds.alias("round"), F.col("event_id").alias("read_idx"), F.col("value").alias("score"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, embedding)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
