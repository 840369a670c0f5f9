"""Models and their evaluation as compositions of operators: exact and low-rank scoring, paths over nu, overlapping areas."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import active_ks, weights_or_default
from ..functions.statistics import auc, auc_of_reads
from ..operators import density, distances, features, kernels, nystrom, ocsvm, reports, sampling
from ..operators.kernel_rows import EmbeddingRows, StringRows

READ = features.READ


@dataclass(frozen=True)
class Kernel:
    """A multi-k kernel: longest k, mismatches, weights by k (default: those of the mismatch level); or one over the tokens of an own analyzer."""

    max_k: int = 6
    mismatches: int = 1
    weights: tuple[float, ...] | None = None
    analyzer: Callable[[str], Iterable[str]] | None = None

    @property
    def by_k(self) -> dict[int, float]:
        if self.analyzer is not None:
            return {1: 1.0}
        w = weights_or_default(self.max_k, self.mismatches, None if self.weights is None else list(self.weights))
        return {k: w[k - 1] for k in active_ks(self.max_k, self.mismatches, w)}

    def features(self, reads: DataFrame) -> DataFrame:
        if self.analyzer is not None:
            return features.analyzed(reads, self.analyzer)
        w = weights_or_default(self.max_k, self.mismatches, None if self.weights is None else list(self.weights))
        return features.combined_features(reads, self.max_k, self.mismatches, w)

    def rows(self, reads: DataFrame) -> DataFrame:
        """The features as models take them: one row a read where strings have numbers (with mismatches), else a row a feature."""
        if self.analyzer is None and self.mismatches > 0:
            return features.read_vectors(reads, sorted(self.by_k), self.mismatches)
        return self.features(reads)


def exact_scores(train: DataFrame, test: DataFrame, kernel: Kernel, nu: float = 0.2) -> DataFrame:
    """(patient, read_idx, decision, predicted) of test reads under a model of the training reads."""
    f, w = kernel.rows(train).cache(), kernel.by_k
    alpha, rho = ocsvm.fit_rows(StringRows(train, f, w), nu)
    return decided(test, ocsvm.primal(f.join(alpha.select("id.*"), READ, "left_semi"), alpha, w), kernel, rho)


def decided(test: DataFrame, vector: DataFrame, kernel: Kernel, rho: float) -> DataFrame:
    """(patient, read_idx, decision, predicted) of test reads under the exact model that is a vector over strings and an offset."""
    out = ocsvm.decide_primal(kernel.rows(test), vector, kernel.by_k, rho, test)
    return out.select("id.*", "decision", ocsvm.predict(F.col("decision")).alias("predicted"))


def _params(kernel: Kernel, nu: float, rho: float, backend: str) -> dict:
    return {"backend": backend, "rho": rho, "nu": nu, "max_k": kernel.max_k, "mismatches": kernel.mismatches, "weights": list(kernel.weights or weights_or_default(kernel.max_k, kernel.mismatches))}


def train(reads: DataFrame, kernel: Kernel, nu: float = 0.2, landmarks: int | None = None, seed: int = 42, features: DataFrame | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(params, tables) of a fitted model, as `sources.model_store` keeps it: all that scoring needs.

    Without `landmarks` the exact model, which is one vector over strings; with them a low-rank one: landmarks, W^-1/2, training's
    strings and a vector of as many components. `features` may come from a cache.
    """
    f, w = (kernel.rows(reads) if features is None else features).cache(), kernel.by_k
    spark = reads.sparkSession
    if landmarks is None:
        alpha, rho = ocsvm.fit_rows(StringRows(reads, f, w), nu)
        vector = ocsvm.primal(f.join(alpha.select("id.*"), READ, "left_semi"), alpha, w)
        return _params(kernel, nu, rho, "precomputed"), {"alpha": alpha, "vector": vector}
    state = nystrom.fit(reads, f, w, landmarks, seed)
    v, rho = ocsvm.fit_primal(nystrom.transform(f, state, reads=reads), nu)
    params, tables = state.tables(spark)
    return _params(kernel, nu, rho, "nystrom") | params, tables | {"vector": spark.createDataFrame([(v.tolist(),)], "v array<double>"), "vocabulary": nystrom.vocabulary(f)}


def infer(reads: DataFrame, params: dict, tables: dict[str, DataFrame], features: DataFrame | None = None) -> DataFrame:
    """(patient, read_idx, score) of reads under a stored model of either backend; scores are inverted decisions."""
    kernel = Kernel(params["max_k"], params["mismatches"], tuple(params["weights"]))
    f = kernel.rows(reads) if features is None else features
    if params["backend"] == "nystrom":
        phi = nystrom.transform(f, nystrom.NystromState.of(params, tables), tables["vocabulary"], reads)
        out = ocsvm.decide_linear(phi, np.array(tables["vector"].first().v), params["rho"])
        return out.select(*READ, (-F.col("decision")).alias("score"))
    out = ocsvm.decide_primal(f, tables["vector"], kernel.by_k, params["rho"], reads)
    return out.select("id.*", (-F.col("decision")).alias("score"))


def embedding_scores(train: DataFrame, test: DataFrame, kind: str = "linear", nu: float = 0.2, gamma: float | None = None) -> DataFrame:
    """(id, decision, predicted) of test embeddings under a model of training embeddings; gamma comes from training."""
    gamma = kernels.embedding_gamma(train) if kind == "rbf" and gamma is None else gamma
    alpha, rho = ocsvm.fit_rows(EmbeddingRows(train, kind, gamma), nu)
    out = kernels.embedding_sums(test, train.join(alpha, "id"), kind, gamma).select("id", (F.col("dot") - rho).alias("decision"))
    return out.select("id", "decision", ocsvm.predict(F.col("decision")).alias("predicted"))


def low_rank_scores(train: DataFrame, test: DataFrame, kernel: Kernel, m: int, nu: float = 0.2, seed: int = 42, passes: int | None = None) -> DataFrame:
    """(patient, read_idx, decision, predicted) over Nystroem maps with m landmarks."""
    f, g = kernel.rows(train).cache(), kernel.rows(test)
    state = nystrom.fit(train, f, kernel.by_k, m, seed)
    vocabulary = nystrom.vocabulary(f)
    w, rho = ocsvm.fit_primal(nystrom.transform(f, state, reads=train), nu, passes)
    out = ocsvm.decide_linear(nystrom.transform(g, state, vocabulary, test), w, rho)
    return out.select("*", ocsvm.predict(F.col("decision")).alias("predicted"))


def evaluate(scored: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """Read-level area and report, patient means and their area."""
    rows = scored.join(test.select(*READ, "label"), READ).withColumn("score", -F.col("decision"))
    patients = rows.groupBy("patient", "label").agg(F.avg("score").alias("value"), F.count("*").alias("n"))
    return {"reads": auc_of_reads(rows, "score", F.col("label") == -1), "report": reports.classification_report(rows, "label", "predicted"), "patients": patients, "patient_auc": auc(patients, "value", F.col("label") == -1, [])}


def nu_models(train: DataFrame, kernel: Kernel, nus: list[float]) -> dict[float, tuple[DataFrame, float]]:
    """(vector over strings, rho) of the exact model at each nu, fitted as one path: each begins at the weights of the one before."""
    f, w = kernel.rows(train).cache(), kernel.by_k
    rows, out = StringRows(train, f, w), {}
    for nu, model in ocsvm.solve_path(rows, nus).items():
        alpha = rows.with_alpha(model.alpha)
        out[nu] = ocsvm.primal(f.join(alpha.select("id.*"), READ, "left_semi"), alpha, w), model.rho
    return out


def nu_comparison(train: DataFrame, test: DataFrame, kernel: Kernel, nus: list[float], n_reads: int, held_out: bool = True, seed: int = 42) -> DataFrame:
    """(nu, aggregator, n_reads, rep, [subject], auc) under models fitted at each nu: an area for each healthy subject of `test` against its
    tumors (held_out), or one for all, of `n_reads` sampled reads by every aggregator."""
    g, out = kernel.rows(test).cache(), None
    for nu, (vector, rho) in nu_models(train, kernel, nus).items():
        scored = ocsvm.decide_primal(g, vector, kernel.by_k, rho, test).select("id.*", (-F.col("decision")).alias("score")).join(test.select(*READ, "label"), READ)
        units = reports.heatmap_units(scored.withColumnRenamed("patient", "subject"), [n_reads], False, held_out, seed=seed).withColumn("nu", F.lit(nu))
        out = units if out is None else out.unionByName(units)
    return out


def reference_curve(products: DataFrame, points: int = 512) -> DataFrame:
    """(grid_i, x, y): density of distances between different training reads, from a normalised kernel (i, j, k), i <= j."""
    d = products.filter("i <> j").select(F.lit(1).alias("all"), kernels.distance(F.col("k")).alias("d"))
    return density.curve(d, ["all"], "d", points).drop("all")


def reference_scores(cross: DataFrame, reference: DataFrame, points: int = 512) -> DataFrame:
    """(patient, oa, anomaly_score): each patient's distances to training reads, as a density on the reference's grid."""
    top = F.broadcast(reference.agg(F.max("x").alias("top")))
    d = cross.select(F.col("i.patient").alias("patient"), kernels.distance(F.col("k")).alias("d"))
    m = density.moments(d, ["patient"], "d").join(top, F.lit(True))
    grids = m.select("patient", "n", "h", F.lit(0.0).alias("lo"), (F.col("top") / (points - 1)).alias("step"), F.lit(points).alias("m"))
    own = density.gaussian_density(d, grids, ["patient"], "d")
    return density.oa_on_grid(reference, own, ["patient"]).withColumn("anomaly_score", 1 - F.col("oa"))


def reference_overlaps(train: DataFrame, test: DataFrame, weights: dict[int, float], points: int = 512) -> DataFrame:
    """(patient, oa, anomaly_score) as `reference_scores` of `reference_curve`, from features: pairs of reads are added up where they are made."""
    reference, own = distances.reference_densities(train, test, weights, points)
    return density.oa_on_grid(reference, own, ["patient"]).withColumn("anomaly_score", 1 - F.col("oa"))


def compare_all(scores: DataFrame, points: int = 1024) -> DataFrame:
    """(comparison_type, a, b, oa, anomaly_score): healthy against tumor, and healthy pairs."""
    kind = F.when(F.col("tumor"), "healthy_vs_tumor").otherwise("healthy_vs_healthy").alias("comparison_type")
    return density.oa_all(scores, points=points).select(kind, "a", "b", "oa", (1 - F.col("oa")).alias("anomaly_score"))
