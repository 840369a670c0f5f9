"""Models and references as a folder of Parquet tables and one row of parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_model(spark: SparkSession, path: str, params: dict, tables: dict[str, DataFrame]) -> None:
    """`params` as JSON, each table by name; the backend defaults to "precomputed"."""
    params = {"backend": "precomputed"} | params | {"tables": sorted(tables)}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str, backend: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(params, tables); an unexpected backend raises."""
    params = json.loads(spark.read.parquet(f"{path}/params").first()[0])
    if backend and params["backend"] != backend:
        raise ValueError(f"the model's backend is {params['backend']}, not {backend}")
    return params, {name: spark.read.parquet(f"{path}/{name}") for name in params["tables"]}


def save_features(features: DataFrame, path: str) -> None:
    """A feature cache that folds share; a fold reads its patients' partitions only."""
    features.write.mode("overwrite").partitionBy("patient").parquet(path)


def load_features(spark: SparkSession, path: str, patients: list[str]) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("patient").isin(patients))
