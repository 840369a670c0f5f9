"""Score tables: wide CSV files with a column a round or subject, read to rows and written from rows; work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.statistics import running_before

#: The fields of a result file.
LOO_FIELDS = ["fold_name", "held_out_patient", "tumor_patient", "patient_auc", "seq_auc", "mean_score_healthy", "mean_score_tumor", "num_train_seqs", "num_test_seqs"]


def subject_of(path: Column) -> Column:
    """`Colo_11` of .../Colo_11_scores_seed42.csv"""
    return F.split(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), "_scores_")[0]


def fold_of(path: Column) -> Column:
    """The LOO directory's subject."""
    return F.replace(F.element_at(F.split(path, "/"), -2), F.lit("LOO_"), F.lit(""))


def subject_class(name: Column) -> Column:
    """'tumor' for Colo..., 'healthy' for Healthy..., else 'unknown'."""
    return F.when(F.lower(name).startswith("colo"), "tumor").when(F.lower(name).startswith("healthy"), "healthy").otherwise("unknown")


def natural_order(name: Column, label: Column) -> list[Column]:
    """Healthy first, then by the number in the name, names without one last."""
    number = F.regexp_extract(name, r"(\d+)", 1)
    return [F.when(label == -1, 1).otherwise(0), F.when(number == "", F.lit(float("inf"))).otherwise(number.try_cast("double")), name]


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """(file, column, row, score): CSV files with a header and a column of scores each; blanks are no rows."""
    raw = spark.read.option("header", True).csv(path)
    names = raw.columns
    rows = spark.read.option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    long = rows.unpivot(["file", "row"], names, "column", "score")
    return long.select("file", "column", "row", F.trim("score").try_cast("double").alias("score")).filter("score IS NOT NULL")


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """(subject, round, row, score) of files with columns round_1, round_2, ...; a single anomaly_score column is round 1."""
    number = F.regexp_extract("column", r"round_(\d+)", 1)
    return read_wide(spark, path).select(subject_of(F.col("file")).alias("subject"), F.when(number == "", 1).otherwise(number.try_cast("int")).alias("round"), "row", "score")


def read_pooled(spark: SparkSession, path: str) -> DataFrame:
    """(subject, row, score): all columns of a file as one subject's scores."""
    return read_wide(spark, path).select(subject_of(F.col("file")).alias("subject"), "row", "score")


def widen(scores: DataFrame, column: str, values: list, prefix: str = "") -> DataFrame:
    """(row, one column a value): ragged columns end in nulls. The values are given, so the plan needs no pass to find them.

    A row's place in its column is a prefix sum over ranges of read_idx, so no column is made in one task.
    """
    rows = running_before(scores.withColumn("one_", F.lit(1)), "read_idx", ["one_"], [column]).withColumnRenamed("before_one_", "row")
    wide = rows.groupBy("row").pivot(column, values).agg(F.first("score"))
    return wide.select("row", *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "error") -> None:
    """CSV with a header; nulls are blank."""
    (df.orderBy(*order) if order else df).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_rounds(scores: DataFrame, rounds: list[int], path: str) -> None:
    write_csv(widen(scores, "round", rounds, "round_").orderBy("row").drop("row"), path)


def write_loo_results(results: DataFrame, path: str) -> None:
    """The nine result fields; others are left out."""
    write_csv(results.select(*LOO_FIELDS), path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.json(path)


def append_summary(df: DataFrame, path: str) -> None:
    """Add a fold's rows; a fold that is there already is replaced, so a resumed run repeats nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def outstanding(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The part of a work list that has no output yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def latest(paths: DataFrame) -> DataFrame:
    """The most recent path of (path, modified)."""
    return paths.agg(F.max_by("path", "modified").alias("path"))
