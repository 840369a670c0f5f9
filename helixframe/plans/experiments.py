"""Experiments that end in files: leave-one-out runs, scoring of saved models, landmark sweeps, overlapping areas.

A run writes as it goes, a folder a fold; a fold that is there already is not run again. Feature caches are partitioned by
patient and shared by folds. Each fold trains a model of its own: loops are over models, never over rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.statistics import auc, auc_of_reads, running_before, spearman
from ..operators import density, kernels, nystrom, ocsvm, reports, sampling
from ..operators.kernel_rows import StringRows
from ..sources import model_store, score_tables
from ..storage import saved
from .pipelines import READ, Kernel, embedding_scores, infer, reference_curve, reference_scores, train


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, *paths: str) -> None:
    """Raise before any work if an input is missing."""
    missing = [p for p in paths if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def feature_cache(reads: DataFrame, kernel: Kernel, path: str) -> str:
    """Write the features of all reads once; returns the path."""
    if not _exists(reads.sparkSession, path):
        model_store.save_features(kernel.rows(reads), path)
    return path


def _features(rows: DataFrame, kernel: Kernel, cache: str | None) -> DataFrame:
    if cache is None:
        return kernel.rows(rows)
    patients = [r.patient for r in rows.select("patient").distinct().collect()]
    return model_store.load_features(rows.sparkSession, cache, patients).join(rows.select(*READ), READ, "left_semi")


def _fitted(rows: DataFrame, kernel: Kernel, nu: float, ratio: float | None, seed: int, cache: str | None, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """Train and save a model, or load the one that is there."""
    spark = rows.sparkSession
    if not _exists(spark, f"{path}/params"):
        m = None if ratio is None else nystrom.landmark_count(ratio, rows.count())
        model_store.save_model(spark, path, *train(rows, kernel, nu, m, seed, _features(rows, kernel, cache)))
    return model_store.load_model(spark, path, "precomputed" if ratio is None else "nystrom")


def _scored(rows: DataFrame, kernel: Kernel, model, cache: str | None) -> DataFrame:
    keep = [c for c in ("label", "round") if c in rows.columns]
    return infer(rows, *model, _features(rows, kernel, cache)).join(rows.select(*READ, *keep), READ)


def train_and_save(reads: DataFrame, kernel: Kernel, path: str, nu: float = 0.2, ratio: float | None = None, seed: int = 42) -> None:
    _fitted(reads, kernel, nu, ratio, seed, None, path)


def infer_cohort(reads: DataFrame, path: str, out: str) -> DataFrame:
    """Scores of a cohort under a saved model as CSV (patient, read_idx, anomaly_score), and a row a patient."""
    require(reads.sparkSession, f"{path}/params")
    model = model_store.load_model(reads.sparkSession, path)
    scores = infer(reads, *model).select(*READ, F.col("score").alias("anomaly_score"))
    score_tables.write_csv(scores, f"{out}/scores", READ)
    patients = reads.sparkSession.read.option("header", True).csv(f"{out}/scores", inferSchema=True).groupBy("patient").agg(F.avg("anomaly_score").alias("mean_score"), F.count("*").alias("n_sequences"))
    score_tables.write_csv(patients, f"{out}/patients", ["patient"])
    return patients


def leave_one_out(reads: DataFrame, kernel: Kernel, out: str, *, max_train: int, max_test: int, nu: float = 0.2, ratio: float | None = None, rounds: tuple[int, int] | None = None, cache: bool = False, only_tumors: bool = False, tumors: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Each healthy patient held out once: a saved model, scores, summary and results a fold; returns (fold, subject, label, mean_score, std_score, n_sequences).

    ratio: a low-rank model with that share of landmarks instead of the exact one. rounds = (number, reads of a round): disjoint
    rounds of reads that training did not use, a score column each, instead of one sample. only_tumors: score tumors alone,
    under models that a former run may have saved. cache: features are written once and shared by folds. tumors: those to score.
    """
    spark = reads.sparkSession
    healthy = sorted(r.patient for r in reads.filter("label = 1").select("patient").distinct().collect())
    store = feature_cache(sampling.readable(reads), kernel, f"{out}/features") if cache else None
    name = "tumors" if only_tumors else "summary"
    for held in healthy:
        fold = f"LOO_{held}"
        if _exists(spark, f"{out}/{name}/fold={fold}"):
            continue
        pool = reads.filter((F.col("label") == 1) & (F.col("patient") != held))
        own = sampling.stratified(pool, max_train, len(healthy) - 1, seed)
        model = _fitted(own, kernel, nu, ratio, seed, store, f"{out}/models/{fold}")
        others = reads.filter(F.col("label") == -1) if only_tumors else reads.filter((F.col("label") == -1) | (F.col("patient") == held))
        others = others if tumors is None else others.filter((F.col("label") == 1) | F.col("patient").isin(tumors))
        n = others.select("patient").distinct().count()
        rows = sampling.stratified(others, max_test, n, seed + 1) if rounds is None else sampling.disjoint_rounds(others, *rounds, seed + 1, own, strict=False)
        scored = _scored(rows, kernel, model, store).withColumnRenamed("patient", "subject")
        scored.write.mode("overwrite").parquet(f"{out}/scores_rows/{fold}")
        scored = spark.read.parquet(f"{out}/scores_rows/{fold}")
        if rounds is None:
            subjects = sorted(r.subject for r in scored.select("subject").distinct().collect())
            score_tables.write_csv(score_tables.widen(scored, "subject", subjects).orderBy("row").drop("row"), f"{out}/scores/{fold}", mode="overwrite")
        else:
            for r in scored.select("subject").distinct().collect():
                one = scored.filter(F.col("subject") == r.subject)
                score_tables.write_csv(score_tables.widen(one, "round", list(range(1, rounds[0] + 1)), "round_").orderBy("row").drop("row"), f"{out}/scores/{fold}/{r.subject}_scores_seed{seed}", mode="overwrite")
            score_tables.write_csv(reports.round_summary(scored), f"{out}/rounds/{fold}", ["subject", "round"], "overwrite")
        if not only_tumors:
            score_tables.write_csv(loo_results(scored, fold, held, own.count()).select(*score_tables.LOO_FIELDS), f"{out}/results/{fold}", mode="overwrite")
        rows = scored.groupBy("subject", "label").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.count("*").alias("n_sequences"))
        score_tables.append_summary(rows.withColumn("fold", F.lit(fold)), f"{out}/{name}")
    return spark.read.parquet(f"{out}/{name}").select("fold", "subject", "label", "mean_score", "std_score", "n_sequences")


def held_out_areas(scored: DataFrame, held: str) -> DataFrame:
    """(subject, seq_auc): each tumor patient's reads against the held-out patient's.

    Held-out scores are counted by value once and summed up to each value; a tumor read then looks up how many lie below it. No
    tumor patient is paired with the held-out reads.
    """
    values = scored.groupBy("score").agg(F.count_if(F.col("subject") == held).alias("h"))
    below = running_before(values, "score", ["h"]).select("score", (F.col("before_h") + F.col("h") / 2).alias("won"))
    total = F.broadcast(values.agg(F.sum("h").alias("n_h")))
    tumor = scored.filter("label = -1").groupBy("subject", "score").agg(F.count("*").alias("c")).join(below, "score")
    return tumor.groupBy("subject").agg(F.sum(F.col("c") * F.col("won")).alias("won"), F.sum("c").alias("n_t")).join(total, F.lit(True)).select("subject", (F.col("won") / F.nullif(F.col("n_t") * F.col("n_h"), F.lit(0))).alias("seq_auc"))


def loo_results(scored: DataFrame, fold: str, held: str, n_train: int) -> DataFrame:
    """The nine result fields of a fold, a row for each tumor patient against the held-out one."""
    healthy = scored.filter(F.col("subject") == held).agg(F.avg("score").alias("mean_score_healthy"), F.count("*").alias("n_h"))
    tumor = scored.filter("label = -1").groupBy("subject").agg(F.avg("score").alias("mean_score_tumor"), F.count("*").alias("n_t"))
    rows = tumor.join(held_out_areas(scored, held), "subject").join(F.broadcast(healthy), F.lit(True))
    patient = F.when(F.col("mean_score_tumor") > F.col("mean_score_healthy"), 1.0).when(F.col("mean_score_tumor") == F.col("mean_score_healthy"), 0.5).otherwise(0.0)
    return rows.select(F.lit(fold).alias("fold_name"), F.lit(held).alias("held_out_patient"), F.col("subject").alias("tumor_patient"), patient.alias("patient_auc"), "seq_auc", "mean_score_healthy", "mean_score_tumor", F.lit(n_train).alias("num_train_seqs"), (F.col("n_h") + F.col("n_t")).alias("num_test_seqs"))


def select_landmarks(own: DataFrame, test: DataFrame, kernel: Kernel, out: str, ratios: list[float], seeds: list[int], nu: float = 0.2, sample: int = 2000) -> DataFrame:
    """Low-rank models of several ratios and seeds against the exact one: metrics and their means by ratio as CSV, a recommendation as text.

    Intrinsic errors (Frobenius, spectral, diagonal) are those of a sample of at most `sample` training reads, on the driver.
    """
    import time

    spark = own.sparkSession
    f, w = kernel.rows(own).cache(), kernel.by_k
    exact = infer(test, *train(own, kernel, nu, features=f)).select(*READ, F.col("score").alias("exact")).cache()
    some = sampling.landmarks(own, sample, 1)
    rows = kernels.vectors(f.join(F.broadcast(some), READ, "left_semi"), w).toArrow()
    length = kernels.norms(rows["vectors"], w)
    true, ids, n, found = kernels.product(rows["vectors"], rows["vectors"], w) / np.outer(length, length), rows["id"].to_pylist(), own.count(), []
    base = auc_of_reads(exact.join(test.select(*READ, "label"), READ), "exact", F.col("label") == -1).first().auc
    for ratio in ratios:
        for seed in seeds:
            start, m = time.perf_counter(), nystrom.landmark_count(ratio, n)
            params, tables = train(own, kernel, nu, m, seed, f)
            state = nystrom.NystromState.of(params, tables)
            near = infer(test, params, tables).join(exact, READ).join(test.select(*READ, "label"), READ).cache()
            maps = nystrom.transform(f.join(F.broadcast(some), READ, "left_semi"), state).toArrow()
            place = {(x, y): n for n, (x, y) in enumerate(zip(maps["patient"].to_pylist(), maps["read_idx"].to_pylist()))}
            phi = np.asarray(maps["phi"].combine_chunks().flatten()).reshape(maps.num_rows, -1)
            p = phi[[place[i["patient"], i["read_idx"]] for i in ids]]
            diff = true - p @ p.T
            area, rank, gap = auc_of_reads(near, "score", F.col("label") == -1).first().auc, spearman(near, "score", "exact").first().spearman, reports.score_gap(near).first()
            found.append((ratio, m, seed, params["kept"], time.perf_counter() - start, float(np.linalg.norm(diff) / max(np.linalg.norm(true), 1e-12)), nystrom.spectral_error(true, p), float(np.abs(np.diag(diff)).max()), float(np.abs(np.diag(diff)).mean()), area, rank, gap.score_gap, gap.mean_healthy_score, gap.mean_tumor_score))
            near.unpersist()
    columns = "m_ratio double, m int, landmark_seed int, n_components_effective int, elapsed_s double, rel_frobenius_error double, rel_spectral_error double, max_diag_error double, mean_diag_error double, auc double, spearman_corr double, score_gap double, mean_healthy_score double, mean_tumor_score double"
    runs = spark.createDataFrame(found, columns)
    score_tables.write_csv(runs, f"{out}/metrics", ["m", "landmark_seed"])
    score_tables.write_csv(reports.by_ratio(runs), f"{out}/by_ratio", ["m_ratio"])
    best = reports.recommend(runs, base).first()
    text = f"recommended ratio: {best.m_ratio}" if best else "no ratio is near the exact model"
    spark.createDataFrame([(f"exact AUC {base:.6f}",), (text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/recommendation")
    return runs


def build_reference(products: DataFrame, path: str, points: int = 512) -> DataFrame:
    """Save the reference curve of a normalised training kernel (i, j, k), and read it back."""
    model_store.save_model(products.sparkSession, path, {"backend": "reference", "points": points}, {"curve": reference_curve(products, points)})
    return model_store.load_model(products.sparkSession, path, "reference")[1]["curve"]


def evaluate_overlap(cross: DataFrame, reference: DataFrame, labels: DataFrame, points: int = 512) -> tuple[DataFrame, DataFrame]:
    """((patient, label, oa, anomaly_score), (auc, n_pos, n_neg)): patients' distances to training reads against a reference curve."""
    oas = reference_scores(cross, reference, points).join(labels, "patient").select("patient", "label", "oa", "anomaly_score")
    return oas, auc(oas, "anomaly_score", F.col("label") == -1, [])


def embedding_distances(test: DataFrame, own: DataFrame, kind: str = "rbf") -> DataFrame:
    """(i, j, k) of a normalised kernel between rows of embeddings (patient, id, embedding); i and j are (patient, id)."""
    gamma = kernels.embedding_gamma(own) if kind == "rbf" else None
    k = kernels.embedding_kernel(test, own, kind, gamma)
    a, b = (x.select(F.col("id").alias(n), F.struct("patient", "id").alias(f"{n}_")) for x, n in ((test, "i"), (own, "j")))
    if kind == "linear":
        square = lambda x: F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        n = lambda x, c: x.select(F.col("id").alias(c), F.sqrt(F.greatest(square(x), F.lit(1e-12))).alias(f"n{c}"))
        k = k.join(n(test, "i"), "i").join(n(own, "j"), "j").select("i", "j", (F.col("k") / (F.col("ni") * F.col("nj"))).alias("k"))
    return k.join(a, "i").join(b, "j").select(F.col("i_").alias("i"), F.col("j_").alias("j"), "k")


def _write_overlap(oas: DataFrame, area: DataFrame, out: str) -> DataFrame:
    """Patients' overlaps as CSV and the area as JSON; returns the area as it was written."""
    score_tables.write_csv(oas, f"{out}/patients", ["label", "patient"], "overwrite")
    area.coalesce(1).write.mode("overwrite").json(f"{out}/area")
    return area.sparkSession.read.schema(area.schema).json(f"{out}/area")


def overlap_experiment(test: DataFrame, out: str, *, own: DataFrame | None = None, kernel: Kernel | None = None, reference: str | None = None, points: int = 512) -> DataFrame:
    """Patients (test: patient, read_idx, label, seq) by how little their distances to training reads overlap with training's own; files and (auc, n_pos, n_neg).

    Standard: training reads `own` under `kernel`; their curve and features are saved as `out`/reference. Fixed: `reference` is such a
    folder of a former run, whose kernel, training features and curve are used as they are.
    """
    spark = test.sparkSession
    if reference is None:
        if own is None or kernel is None:
            raise ValueError("a run without a reference needs training reads and a kernel")
        reference = f"{out}/reference"
        f, w = kernel.rows(own).cache(), kernel.by_k
        curve = reference_curve(kernels.normalise(kernels.gram(f, w), kernels.diagonal(f, w)), points)
        params = {"backend": "reference", "points": points, "max_k": kernel.max_k, "mismatches": kernel.mismatches, "weights": None if kernel.weights is None else list(kernel.weights)}
        model_store.save_model(spark, reference, params, {"curve": curve, "features": f})
    require(spark, f"{reference}/params")
    params, tables = model_store.load_model(spark, reference, "reference")
    kernel = Kernel(params["max_k"], params["mismatches"], params["weights"] and tuple(params["weights"]))
    f, g, w = tables["features"], kernel.rows(test).cache(), kernel.by_k
    cross = kernels.normalise(kernels.cross_gram(g, f, w), kernels.diagonal(g, w), kernels.diagonal(f, w))
    return _write_overlap(*evaluate_overlap(cross, tables["curve"], test.select("patient", "label").distinct(), params["points"]), out)


def embedding_overlap_experiment(own: DataFrame, test: DataFrame, out: str, kind: str = "rbf", points: int = 512) -> DataFrame:
    """The same of embeddings: own (patient, id, embedding), test with a label; files and (auc, n_pos, n_neg)."""
    curve = saved(reference_curve(embedding_distances(own, own, kind).filter("i <= j"), points), "curve")
    oas, area = evaluate_overlap(embedding_distances(test.drop("label"), own, kind), curve, test.select("patient", "label").distinct(), points)
    return _write_overlap(oas, area, out)


def embedding_experiment(own: DataFrame, test: DataFrame, out: str, kind: str = "rbf", nu: float = 0.2) -> DataFrame:
    """A one-class model of embeddings (id, embedding) over test rows (patient, label, id, embedding): scores and patient means as CSV, the patient-level
    area as JSON; returns (auc, n_pos, n_neg)."""
    scored = embedding_scores(own, test, kind, nu).join(test.select("id", "patient", "label"), "id")
    rows = saved(scored.select("patient", "label", "id", (-F.col("decision")).alias("anomaly_score"), "predicted"), "scores")
    score_tables.write_csv(rows.select("patient", "id", "anomaly_score"), f"{out}/scores", ["patient", "id"], "overwrite")
    patients = rows.groupBy("patient", "label").agg(F.avg("anomaly_score").alias("mean_score"), F.count("*").alias("n_sequences"))
    score_tables.write_csv(reports.classification_report(rows, "label", "predicted"), f"{out}/report", ["class"], "overwrite")
    return _write_overlap(patients, auc(patients, "mean_score", F.col("label") == -1, []), out)


def seed_stability(reads: DataFrame, kernel: Kernel, out: str, *, own: list[str], a: str, b: str, seeds: list[int], max_train: int, max_test: int, nu: float = 0.2, test_seed: int = 42) -> DataFrame:
    """How the overlap of two patients' scores depends on which reads of `own` a model is trained on.

    Test reads are drawn once. The features of all seeds' reads together are made and stored once; each model takes its part of them. A seed's scores
    (a column a patient) and its row go to files, and a seed whose row is there is not run again. Returns (train_seed, oa,
    mean_score_a, mean_score_b, n_train, n_test_a, n_test_b).
    """
    spark = reads.sparkSession
    missing = {a, b, *own} - {r.patient for r in reads.select("patient").distinct().collect()}
    if missing:
        raise ValueError(f"no reads of {', '.join(sorted(missing))}")
    todo = [s for s in seeds if not _exists(spark, f"{out}/results/fold={s}")]
    if todo:
        w = kernel.by_k
        test = sampling.stratified(reads.filter(F.col("patient").isin(a, b)), 2 * max_test, 2, test_seed)
        g = saved(kernel.rows(test), "test")
        pool = reads.filter(F.col("patient").isin(own))
        samples = {s: saved(sampling.stratified(pool, max_train, len(own), s).select(*READ), "sample") for s in todo}
        union = samples[todo[0]]
        for s in todo[1:]:
            union = union.unionByName(samples[s])
        f = saved(kernel.rows(pool.join(union.distinct(), READ, "left_semi")), "union")
    for s in todo:
        part = f.join(samples[s], READ, "left_semi")
        alpha, rho = ocsvm.fit_rows(StringRows(samples[s], part, w), nu)
        vector = ocsvm.primal(part.join(alpha.select("id.*"), READ, "left_semi"), alpha, w)
        scored = saved(ocsvm.decide_primal(g, vector, w, rho, test).select(F.col("id.patient").alias("subject"), F.col("id.read_idx").alias("read_idx"), (-F.col("decision")).alias("score")), "scored")
        score_tables.write_csv(score_tables.widen(scored, "subject", [a, b]).orderBy("row").drop("row"), f"{out}/anomaly_scores/seed{s}_scores", mode="overwrite")
        of = lambda p, x: x.filter(F.col("subject") == p)
        means = [of(p, scored).agg(F.avg("score").alias(f"mean_score_{n}"), F.count("*").alias(f"n_test_{n}")) for n, p in (("a", a), ("b", b))]
        row = density.oa_pairs(scored, spark.createDataFrame([(a, b)], "a string, b string")).join(means[0], F.lit(True)).join(means[1], F.lit(True))
        row = row.select(F.lit(s).alias("train_seed"), "oa", "mean_score_a", "mean_score_b", F.lit(samples[s].count()).alias("n_train"), "n_test_a", "n_test_b", F.lit(str(s)).alias("fold"))
        score_tables.append_summary(row, f"{out}/results")
    done = spark.read.parquet(f"{out}/results").drop("fold").filter(F.col("train_seed").isin(seeds))
    score_tables.write_csv(done, f"{out}/stability_results", ["train_seed"], "overwrite")
    score_tables.write_csv(reports.describe(done, "oa"), f"{out}/summary", mode="overwrite")
    return done


def reference_stability(reads: DataFrame, kernel: Kernel, out: str, *, size: int = 3, combinations: int = 3, max_train: int = 3000, seed: int = 42, points: int = 512) -> DataFrame:
    """Reference curves of several sets of healthy patients, and how much every two of them overlap: (a, b, oa), as CSV with a JSON report by set.

    Sets are drawn by digest order; each has its own training sample, kernel and curve. Curves are compared on the first set's grid.
    """
    spark = reads.sparkSession
    healthy = reads.filter("label = 1")
    drawn = [r.members for r in sampling.combinations(healthy.select("patient").distinct(), size, combinations, seed).collect()]
    w, top, curves = kernel.by_k, None, []
    for members in drawn:
        own = sampling.stratified(healthy.filter(F.col("patient").isin(members)), max_train, size, seed)
        f = kernel.rows(own).cache()
        d = saved(kernels.normalise(kernels.gram(f, w), kernels.diagonal(f, w)).filter("i <> j").select(F.lit("+".join(members)).alias("members"), kernels.distance(F.col("k")).alias("d")), "distances")
        f.unpersist()
        top = d.agg(F.max("d")).first()[0] if top is None else top
        curves.append((d.first().members, saved(density.curve(d, ["members"], "d", points, hi=F.lit(top)), "curve")))
    rows = None
    for i, (a, x) in enumerate(curves):
        for b, y in curves[i + 1 :]:
            one = density.oa_on_grid(x.drop("members"), y, ["members"]).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "oa")
            rows = one if rows is None else rows.unionByName(one)
    names = spark.createDataFrame([(a,) for a, _ in curves], "subject string")
    full = density.mirrored(spark.createDataFrame([], "a string, b string, oa double") if rows is None else saved(rows, "overlaps"), names)
    score_tables.write_csv(full, f"{out}/matrix", ["a", "b"], "overwrite")
    density.by_row(full).write.mode("overwrite").json(f"{out}/report")
    return full


def validate_reference(scores: DataFrame, out: str, points: int = 1024) -> DataFrame:
    """The full mirrored matrix of overlaps between healthy subjects, as CSV, and a JSON report of its rows."""
    subjects = scores.filter("label = 1").select("subject").distinct()
    full = density.mirrored(density.oa_all(scores, False, points), subjects)
    score_tables.write_csv(full, f"{out}/matrix", ["a", "b"])
    score_tables.write_report(density.by_row(full), f"{out}/report")
    return full
