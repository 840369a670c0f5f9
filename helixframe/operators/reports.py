"""Tables behind reports: summaries, areas by aggregator and sample size, tails, histograms, thresholds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import AGGREGATORS, aggregate_all, auc, quantiles, running_before
from ..storage import saved
from .sampling import sampled_aggregates, subsample_scores


def subject_scores(scores: DataFrame) -> DataFrame:
    """(subject, label, mean_score, n) of inverted decisions."""
    return scores.groupBy("subject", "label").agg(F.avg(-F.col("score")).alias("mean_score"), F.count("*").alias("n"))


def round_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("subject", "label", "round").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.stddev_pop("score"), 6).alias("std_score"), F.count("*").alias("n_sequences"))


def subject_summary(scores: DataFrame) -> DataFrame:
    """Mean and deviation of a subject's round means."""
    rounds = scores.groupBy("subject", "label", "round").agg(F.avg("score").alias("m"))
    return rounds.groupBy("subject", "label").agg(F.avg("m").alias("mean_of_rounds"), F.stddev_pop("m").alias("std_of_rounds"), F.count("*").alias("n_rounds"))


def auc_units(values: DataFrame, keys: list[str], held_out: bool) -> DataFrame:
    """(keys, [subject], auc) of aggregated subject values: all healthy against all tumors, or each healthy subject against all tumors.

    One window over a cell's subjects counts the tumors below each healthy value; healthy and tumor subjects are not paired; the
    mean over healthy subjects is the area of all. Values count to nine digits, so that sums which differ only by their order are ties.
    """
    values = values.withColumn("value", F.round("value", 9))
    tumor = F.when(F.col("label") == -1, 1).otherwise(0)
    up_to = F.sum(tumor).over(Window.partitionBy(*keys).orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum(tumor).over(Window.partitionBy(*keys, "value"))
    n = F.sum(tumor).over(Window.partitionBy(*keys))
    each = values.withColumn("auc", (n - up_to + ties / 2) / F.nullif(n, F.lit(0))).filter("label = 1")
    return each.select(*keys, "subject", "auc") if held_out else each.groupBy(*keys).agg(F.avg("auc").alias("auc"))


def heatmap_units(scores: DataFrame, sizes: list[int], by_round: bool, held_out: bool, repeats: int = 1, seed: int = 42, tops: tuple[int, ...] = (100, 500)) -> DataFrame:
    """An area for each cell (aggregator, n_reads, rep, [round], [healthy subject])."""
    keys = ["subject", "round"] if by_round else ["subject"]
    if AGGREGATORS:
        values = aggregate_all(subsample_scores(scores, sizes, keys, repeats, seed), [*keys, "label", "n_reads", "rep"], tops=tops)
    else:
        values = sampled_aggregates(scores, sizes, keys, repeats, seed, tops)
    return auc_units(values, ["aggregator", "n_reads", "rep", *keys[1:]], held_out)


def heatmap(units: DataFrame, keys: list[str] = ["aggregator", "n_reads"]) -> DataFrame:  # noqa: B006
    return units.groupBy(*keys).agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.count("auc").alias("n_auc"))


def boxplot(units: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles, and whiskers at the 5th and 95th percentile."""
    q = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    p = units.groupBy(*keys).agg(F.percentile("auc", F.array(*[F.lit(x) for x in q.values()])).alias("q_"), F.count("auc").alias("n_auc"))
    return p.select(*keys, *[F.col("q_")[i].alias(n) for i, n in enumerate(q)], "n_auc")


def fold_aucs(scores: DataFrame) -> DataFrame:
    """(fold, auc): the held-out subject's reads against all tumor reads would be read-level; this is by subject mean."""
    means = scores.groupBy("subject", "label").agg(F.avg("score").alias("value")).withColumn("cell", F.lit(1))
    return auc_units(means, ["cell"], True).select(F.concat(F.lit("LOO_"), F.col("subject").cast("string")).alias("fold"), "auc")


def describe(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def tail_statistics(scores: DataFrame, right: float = 0.99, left: float = 0.01) -> DataFrame:
    """Moments of each subject, and its shares beyond percentiles of the healthy pool (in percent)."""
    healthy = scores.filter("label = 1")
    cut = F.broadcast(quantiles(healthy, "score", {"hi_": right, "lo_": left}))
    s = F.col("score")
    share = lambda c: 100.0 * F.avg(F.when(c, 1.0).otherwise(0.0))
    return scores.join(cut, F.lit(True)).groupBy("subject", "label").agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), share(s > F.col("hi_")).alias("pct_right"), share(s < F.col("lo_")).alias("pct_left"), F.skewness(s).alias("skewness"), F.kurtosis(s).alias("kurtosis"))


def histogram(scores: DataFrame, keys: list[str], bins: int = 100) -> DataFrame:
    """(keys, bin, n, density) between each key's extremes; the last bin is closed."""
    ends = scores.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return scores.join(ends, keys).withColumn("bin", at).groupBy(*keys, "bin").agg(F.count("*").alias("n"), (F.count("*") / F.first("total") / F.nullif(F.first(width), F.lit(0.0))).alias("density"))


def classification_report(df: DataFrame, truth: str, predicted: str, labels: tuple[int, ...] = (-1, 1)) -> DataFrame:
    """(class, precision, recall, f1, support); what can't be divided is 0."""
    t, p = F.col(truth), F.col(predicted)
    rows = df.groupBy(t.alias("t"), p.alias("p")).agg(F.count("*").alias("n")).withColumn("class", F.explode(F.array(*[F.lit(x) for x in labels])))
    c = F.col("class")
    hit, said, true = (F.sum(F.when(x, F.col("n")).otherwise(0)) for x in ((F.col("t") == c) & (F.col("p") == c), F.col("p") == c, F.col("t") == c))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    r = rows.groupBy("class").agg(hit.alias("hit"), said.alias("said"), true.alias("support"))
    return r.select("class", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2.0 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def score_gap(scores: DataFrame) -> DataFrame:
    tumor, healthy = (F.avg(F.when(F.col("label") == x, F.col("score"))) for x in (-1, 1))
    return scores.agg(healthy.alias("mean_healthy_score"), tumor.alias("mean_tumor_score"), (tumor - healthy).alias("score_gap"))


def by_ratio(runs: DataFrame) -> DataFrame:
    """Means and deviations of each metric by ratio."""
    names = [c for c in ("auc", "spearman_corr", "score_gap", "rel_frobenius_error", "rel_spectral_error", "max_diag_error", "elapsed_s") if c in runs.columns]
    return runs.groupBy("m_ratio").agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))], F.count("*").alias("n"))


def recommend(runs: DataFrame, exact_auc: float, near: float = 0.02, rank: float = 0.95) -> DataFrame:
    """The smallest ratio whose mean AUC is near the exact one and whose scores rank alike."""
    means = runs.groupBy("m_ratio").agg(F.avg("auc").alias("auc"), F.avg("spearman_corr").alias("spearman_corr"))
    return means.filter((F.abs(F.col("auc") - exact_auc) < near) & (F.col("spearman_corr") > rank)).orderBy("m_ratio").limit(1)


def threshold(scores: DataFrame, false_rate: float = 0.01) -> DataFrame:
    """Documentation-derived: the read threshold, a high percentile of healthy scores."""
    return quantiles(scores.filter("label = 1"), "score", {"tau": 1 - false_rate})


def outlier_proportion(scores: DataFrame, false_rate: float = 0.01) -> DataFrame:
    """Documentation-derived: each subject's share of reads above the read threshold."""
    return scores.join(F.broadcast(threshold(scores, false_rate)), F.lit(True)).groupBy("subject", "label").agg(F.avg(F.when(F.col("score") > F.col("tau"), 1.0).otherwise(0.0)).alias("proportion"), F.count("*").alias("n"))


def youden(values: DataFrame) -> DataFrame:
    """Documentation-derived: (threshold, tpr, fpr, j) of greatest tpr - fpr over subject values; the highest threshold on ties."""
    pos, neg = F.when(F.col("label") == -1, 1).otherwise(0), F.when(F.col("label") == -1, 0).otherwise(1)
    counts = values.groupBy("value").agg(F.sum(pos).alias("p"), F.sum(neg).alias("n"))
    run = running_before(counts, "value", ["p", "n"]).join(F.broadcast(counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))), F.lit(True))
    share = lambda c: 1 - F.col(f"before_{c}") / F.nullif(F.col(f"all_{c}"), F.lit(0))
    roc = run.select(F.col("value").alias("threshold"), share("p").alias("tpr"), share("n").alias("fpr"))
    return roc.withColumn("j", F.col("tpr") - F.col("fpr")).orderBy(F.desc(F.round("j", 12)), F.desc("threshold")).limit(1)


def diagnose(values: DataFrame, tau: Column) -> DataFrame:
    return values.withColumn("diagnosis", F.when(F.col("value") >= tau, "TUMOR").otherwise("HEALTHY"))


#: Subjects whose values share a part of the bootstrap, and draws that are made at once for all replicates.
PART, BLOCK = 1024, 1024


def bootstrap_auc(values: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Documentation-derived: median and 95 % interval of the area over stratified resamples of subjects, drawn by digest.

    Subjects are numbered by value within their class, so what is drawn is already a place in order, and falls into a range of about `PART`
    subjects by comparing it with where ranges start. Draws go to their range as packed lists, once; there tumors meet healthy subjects of the
    same range, and between ranges counts are enough. No replicate and no class is a group of its own.
    """
    spark = values.sparkSession
    is_tumor = F.col("label") == -1
    counts = values.groupBy("value").agg(F.count_if(~F.coalesce(is_tumor, F.lit(False))).alias("h"), F.count_if(is_tumor).alias("t"))
    placed = saved(running_before(counts, "value", ["h", "t"]).select("h", "t", "before_h", "before_t", F.floor((F.col("before_h") + F.col("before_t")) / PART).alias("part")), "places")
    starts = placed.groupBy("part").agg(F.min("before_h").alias("h"), F.min("before_t").alias("t"), F.sum("h").alias("nh"), F.sum("t").alias("nt")).orderBy("part").collect()  # a row for PART subjects
    parts, first = np.array([r.part for r in starts], np.int64), {1: np.array([r.h for r in starts], np.int64), -1: np.array([r.t for r in starts], np.int64)}
    sizes = {1: sum(r.nh for r in starts), -1: sum(r.nt for r in starts)}
    healthy_blocks, tumor_blocks = (-(-sizes[x] // BLOCK) for x in (1, -1))

    def draw(batches):
        for b in batches:
            for block in b.column(0).to_pylist():
                label, block = (1, block) if block < healthy_blocks else (-1, block - healthy_blocks)
                draws = [str(k).encode() for k in range(block * BLOCK, min((block + 1) * BLOCK, sizes[label]))]
                heads = b"".join([hashlib.md5(start + k).digest()[:4] for rep in range(1, replicates + 1) for start in [f"{seed}|{rep}|{label}|".encode()] for k in draws])
                k = np.frombuffer(heads, ">u4").astype(np.int64) % sizes[label]
                at = np.searchsorted(first[label], k, "right") - 1
                order = np.argsort(at, kind="stable")
                rep, k, at = (order // len(draws)).astype(np.int32), (k - first[label][at])[order].astype(np.int32), at[order]
                new = np.flatnonzero(np.diff(at, prepend=-1))
                ends = pa.array(np.append(new, len(at)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(parts[at[new]]), pa.array(np.full(len(new), label, np.int32)), pa.ListArray.from_arrays(ends, pa.array(rep)), pa.ListArray.from_arrays(ends, pa.array(k))], ["part", "label", "reps", "ks"])

    def meet(drawn: pa.Table, own: pa.Table) -> pa.Table:
        side, tables = np.asarray(drawn["label"]), {}
        for label, n, before in ((1, "h", "before_h"), (-1, "t", "before_t")):
            n, before = np.asarray(own[n]), np.asarray(own[before])
            order = np.argsort(before, kind="stable")
            order = order[n[order] > 0]
            t, width = np.zeros((replicates, len(before)), np.int64), len(before)
            for chunk in drawn.filter(pa.array(side == label)).to_batches():
                rep, k = np.asarray(chunk.column(2).flatten()), np.asarray(chunk.column(3).flatten())
                place = order[np.searchsorted(before[order] - before.min(), k, "right") - 1] if len(k) else k
                t += np.bincount(rep * np.int64(width) + place, minlength=t.size).reshape(t.shape)
            tables[label] = t
        order = np.lexsort((np.asarray(own["before_t"]), np.asarray(own["before_h"]), np.asarray(own["before_h"]) + np.asarray(own["before_t"])))
        h, t = tables[1][:, order], tables[-1][:, order]
        won = (t * (2 * (np.cumsum(h, 1) - h) + h)).sum(1) / 2
        return pa.table({"part": np.full(replicates, own["part"][0].as_py(), np.int64), "rep": np.arange(replicates, dtype=np.int32), "won": won, "h": h.sum(1), "t": t.sum(1)})

    blocks = healthy_blocks + tumor_blocks
    drawn = spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(draw, "part bigint, label int, reps array<int>, ks array<int>")
    met = drawn.groupBy("part").cogroup(placed.groupBy("part")).applyInArrow(meet, "part bigint, rep int, won double, h bigint, t bigint")
    below = F.sum("h").over(Window.partitionBy("rep").orderBy("part")) - F.col("h")  # a row for PART subjects
    pairs = F.nullif(F.lit(float(sizes[1]) * float(sizes[-1])), F.lit(0.0))
    areas = met.withColumn("won", F.col("won") + F.col("t") * below).groupBy("rep").agg((F.sum("won") / pairs).alias("auc"))
    return areas.agg(F.percentile("auc", F.array(*[F.lit(q) for q in (0.025, 0.5, 0.975)])).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))
