"""Leave-one-out folds and the joins around them. Patients are few, whatever the number of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Folds of a tile, and patients that meet it in one task at most (about): what a task writes, and its writer holds, does not grow with the job.
TILE, SLICE = 512, 4096


def loo_folds(patients: DataFrame) -> DataFrame:
    """(fold, patient, role) of (patient, label): each healthy patient held out once; the other healthy ones train, tumors test.

    A row for two patients is what the job returns. Folds are dealt to tasks in tiles, and a tile's come patient by patient: the columns repeat in
    short cycles, which files store in a fraction of a byte a row. A tile's folds come from a table by tile, row by row; no row holds them as an array,
    which would be copied for each patient.
    """
    p = patients.select("patient", "label").distinct()
    parts = int(patients.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = p.filter("label = 1").select(F.col("patient").alias("held"), F.concat(F.lit("LOO_"), F.col("patient").cast("string")).alias("fold"))
    n = p.agg(F.count("*").alias("all"), F.count_if(F.col("label") == 1).alias("healthy")).first()
    tiles, slices = max(1, -(-n.healthy // TILE)), max(1, -(-n["all"] // SLICE))
    folds = held.select(F.pmod(F.xxhash64("held"), F.lit(tiles)).alias("tile"), "held", "fold")
    sliced = p.withColumn("slice", F.pmod(F.xxhash64("patient"), F.lit(slices)))
    at = patients.sparkSession.range(tiles * slices).select(F.floor(F.col("id") / slices).alias("tile"), (F.col("id") % slices).alias("slice"))
    pairs = at.repartition(max(parts, tiles * slices)).join(F.broadcast(sliced), "slice").join(F.broadcast(folds), "tile")  # both are a row a patient
    role = F.when(F.col("label") == -1, "tumor").when(F.col("patient") == F.col("held"), "held_out").otherwise("train")
    return pairs.select("fold", "patient", role.alias("role"))


def background(scores: DataFrame) -> DataFrame:
    """(subject, n, mean, std, lo, hi) of every subject's background: the healthy scores but its own.

    The pool's sums less the subject's own replace a self-join; extremes are those of the two least and the two greatest healthy
    subjects, of which at most one is the subject itself.
    """
    s = F.col("score")
    own = scores.groupBy("subject", "label").agg(F.count("*").alias("n"), F.sum(s).alias("s"), F.sum(s * s).alias("q"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    healthy = own.filter("label = 1")
    ends = lambda c, name: healthy.orderBy(c, "subject").limit(2).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("v"), "subject")), asc=name == "lo").alias(f"{name}s"))
    pool = healthy.agg(F.sum("n").alias("n2"), F.sum("s").alias("s2"), F.sum("q").alias("q2"))
    pool = F.broadcast(pool.join(ends(F.asc("lo"), "lo"), F.lit(True)).join(ends(F.desc("hi"), "hi"), F.lit(True)))
    mine = lambda c: F.when(F.col("label") == 1, F.col(c)).otherwise(0)
    end = lambda c: F.get(F.filter(F.col(c), lambda x: ~((F.col("label") == 1) & (x.subject == F.col("subject")))), F.lit(0)).v
    rest = own.join(pool, F.lit(True)).select("subject", "label", (F.col("n2") - mine("n")).alias("n"), (F.col("s2") - mine("s")).alias("s"), (F.col("q2") - mine("q")).alias("q"), end("los").alias("lo"), end("his").alias("hi"))
    mean = F.col("s") / F.col("n")
    return rest.filter("n > 0").select("subject", "label", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), "lo", "hi")
