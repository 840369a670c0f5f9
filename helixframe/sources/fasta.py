"""FASTA files as a table of reads, their index, and an audit of the symbols that occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The nucleotide codes of IUPAC, and the gap.
IUPAC = ("A", "C", "G", "T", "U", "R", "Y", "K", "M", "S", "W", "B", "D", "H", "V", "N", "-")


def patient_of(path: Column) -> Column:
    """`Healthy_3` of .../Healthy_3_merged_subset.fa"""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 2, F.substring_index(name, "_", 2)).otherwise(name)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(patient, read_idx, name, seq) of one or many files, plain or compressed by Spark's codecs.

    Records are split by Spark's text reader, so large files are read in parallel. Sequences are upper-cased, their
    line ends (LF and CR) removed; empty ones are dropped. read_idx is the record's place among its file's records in order of
    position; it is stable for the same file.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^>", "").alias("value"))
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r", "")
    body = F.upper(F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)"), "[\r\n]", ""))
    kept = rows.select(patient_of(F.col("file")).alias("patient"), "file", "at", head.alias("name"), body.alias("seq")).filter("trim(name) <> '' OR seq <> ''")
    return number_within(kept, ["patient", "file"], "at", "read_idx").filter("seq <> ''").select("patient", "read_idx", "name", "seq")


def number_within(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Rows numbered from 0 within keys, by `order` (a monotonic id): counts by partition first, so no key's rows meet in one task."""
    part = F.shiftright(order, 33)
    totals = df.groupBy(*keys, part.alias("part")).agg(F.count("*").alias("n"), F.min(order).alias("lo"))
    from pyspark.sql import Window

    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*keys, "part", "before")
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(order)) - 1
    return df.withColumn("part", part).withColumn(name, within).join(before, [*keys, "part"]).withColumn(name, (F.col(name) + F.col("before")).cast("long")).drop("part", "before")


def fasta_index(reads: DataFrame) -> DataFrame:
    """(patient, read_idx, name, length): what a .fai holds that a columnar table still needs."""
    return reads.select("patient", "read_idx", "name", F.length("seq").cast("long").alias("length"))


def get_reads(reads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access by ordinal: rows of `wanted` (patient, read_idx) that exist."""
    return reads.join(wanted.select("patient", "read_idx").distinct(), ["patient", "read_idx"], "left_semi")


def symbol_audit(reads: DataFrame) -> DataFrame:
    """(symbol, status, n_reads): present, missing and unexpected symbols."""
    spark = reads.sparkSession
    seen = reads.select(F.explode(F.array_distinct(F.split(F.upper("seq"), ""))).alias("symbol")).filter("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n_reads"))
    known = spark.createDataFrame([(s,) for s in IUPAC], "symbol string")
    status = F.when(F.col("n_reads").isNull(), "missing").when(F.col("known").isNull(), "unexpected").otherwise("present")
    return known.withColumn("known", F.lit(1)).join(seen, "symbol", "full_outer").select("symbol", status.alias("status"), F.coalesce("n_reads", F.lit(0)).alias("n_reads"))
