"""Intermediate tables in the cluster's shared folder: lineage is cut there, and what is written survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local one only where that is not set and the master is local."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = sc._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="helixframe-")
        if not given.isDefined():
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read back."""
    path, schema = scratch(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Arrow bytes that a Python worker is given at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound what Python workers hold by bytes, whatever the length of rows: by default a batch is 10,000 of them, so it grows until
    partitions hold as many. A lower setting is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, f"{most}b")
