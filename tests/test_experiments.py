"""Experiments end in files, go on where they stopped, and stored models score as fresh ones."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import statistics
from helixframe.operators import density, kernels, nystrom, sampling
from helixframe.plans import experiments, pipelines
from helixframe.sources import model_store, score_tables

KERNEL = pipelines.Kernel(2, 0, (0.4, 0.6))


@pytest.fixture(scope="module")
def reads(spark):
    r = random.Random(5)
    rows = [(f"{kind}_{p}", i, 1 if kind == "Healthy" else -1, "".join(r.choice(letters) for _ in range(30))) for kind, letters in (("Healthy", "AACGT"), ("Colo", "ACGTTT")) for p in range(3) for i in range(14)]
    rows.append(("Colo_0", 99, -1, ""))
    return spark.createDataFrame(rows, "patient string, read_idx long, label int, seq string").cache()


@pytest.mark.parametrize("landmarks", [None, 12])
def test_stored_models_score_alike(spark, reads, tmp_path, landmarks):
    own = reads.filter("label = 1")
    params, tables = pipelines.train(own, KERNEL, 0.3, landmarks)
    model_store.save_model(spark, str(tmp_path / "m"), params, tables)
    fresh = {(r.patient, r.read_idx): r.score for r in pipelines.infer(reads, params, tables).collect()}
    stored = {(r.patient, r.read_idx): r.score for r in pipelines.infer(reads, *model_store.load_model(spark, str(tmp_path / "m"))).collect()}
    assert len(fresh) == reads.count() and stored == pytest.approx(fresh, abs=1e-9)
    assert fresh["Colo_0", 99] == pytest.approx(params["rho"])
    direct = pipelines.exact_scores(own, reads, KERNEL, 0.3) if landmarks is None else pipelines.low_rank_scores(own, reads, KERNEL, landmarks, 0.3)
    assert {(r.patient, r.read_idx): -r.decision for r in direct.collect()} == pytest.approx(fresh, abs=1e-9)


def test_low_rank_scores_rank_as_exact(spark, reads):
    own = reads.filter("label = 1")
    exact = pipelines.exact_scores(own, reads, KERNEL, 0.3).withColumnRenamed("decision", "e")
    near = pipelines.low_rank_scores(own, reads, KERNEL, 20, 0.3).join(exact.select("patient", "read_idx", "e"), ["patient", "read_idx"])
    assert near.agg(F.corr("decision", "e")).first()[0] > 0.95


@pytest.mark.parametrize("ratio,rounds,cache", [(None, None, True), (0.3, None, False), (0.3, (2, 3), True)])
def test_leave_one_out(spark, reads, tmp_path, ratio, rounds, cache):
    out = str(tmp_path / "run")
    options = dict(max_train=16, max_test=20, nu=0.3, ratio=ratio, rounds=rounds, cache=cache, tumors=["Colo_0", "Colo_1"])
    summary = experiments.leave_one_out(reads, KERNEL, out, **options).collect()
    assert sorted({(r.fold, r.subject) for r in summary}) == sorted((f"LOO_Healthy_{h}", s) for h in range(3) for s in (f"Healthy_{h}", "Colo_0", "Colo_1"))
    results = spark.read.option("header", True).csv(f"{out}/results/*")
    assert results.columns == score_tables.LOO_FIELDS and results.count() == 6
    scores = {}
    for r in spark.read.parquet(*[f"{out}/scores_rows/LOO_Healthy_{h}" for h in range(3)]).withColumn("fold", F.regexp_extract(F.col("_metadata.file_path"), "LOO_Healthy_[0-9]", 0)).collect():
        scores.setdefault((r.fold, r.subject), []).append(r.score)
    for r in results.collect():
        h, t = scores[r.fold_name, r.held_out_patient], scores[r.fold_name, r.tumor_patient]
        mean = lambda x: sum(x) / len(x)
        won = sum((a > b) + 0.5 * (a == b) for a in t for b in h) / (len(t) * len(h))
        assert (float(r.seq_auc), float(r.mean_score_healthy), float(r.mean_score_tumor)) == pytest.approx((won, mean(h), mean(t)))
        assert float(r.patient_auc) == (1.0 if mean(t) > mean(h) else 0.5 if mean(t) == mean(h) else 0.0)
        assert (int(r.num_train_seqs), int(r.num_test_seqs)) == (16, len(h) + len(t))
    if rounds:
        long = score_tables.read_rounds(spark, f"{out}/scores/LOO_Healthy_0/Colo_0_scores_seed42")
        assert long.groupBy("round").count().orderBy("round").collect() == [(1, 3), (2, 3)]
        assert spark.read.option("header", True).csv(f"{out}/rounds/*").count() == 18
    else:
        wide = spark.read.option("header", True).csv(f"{out}/scores/LOO_Healthy_1")
        assert sorted(wide.columns) == ["Colo_0", "Colo_1", "Healthy_1"]
    before = spark.read.parquet(f"{out}/summary").inputFiles()
    experiments.leave_one_out(reads, KERNEL, out, **options)
    assert sorted(spark.read.parquet(f"{out}/summary").inputFiles()) == sorted(before)
    tumors = experiments.leave_one_out(reads, KERNEL, out, **options, only_tumors=True).collect()
    same = {(r.fold, r.subject): r.mean_score for r in summary if r.label == -1}
    if rounds:
        assert {(r.fold, r.subject): r.mean_score for r in tumors} == pytest.approx(same, abs=1e-9)
    assert {r.label for r in tumors} == {-1} and len(tumors) == 6


def test_infer_cohort(spark, reads, tmp_path):
    experiments.require(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        experiments.require(spark, str(tmp_path / "none"))
    experiments.train_and_save(reads.filter("label = 1"), KERNEL, str(tmp_path / "m"), 0.3, 0.3)
    patients = experiments.infer_cohort(reads, str(tmp_path / "m"), str(tmp_path / "o"))
    assert patients.count() == 6 and spark.read.option("header", True).csv(str(tmp_path / "o/scores")).columns == ["patient", "read_idx", "anomaly_score"]
    pooled = score_tables.read_pooled(spark, str(tmp_path / "o/patients")).groupBy("subject").count()
    assert pooled.count() >= 1


def test_select_landmarks(spark, reads, tmp_path):
    runs = experiments.select_landmarks(reads.filter("label = 1"), reads, KERNEL, str(tmp_path), [0.1, 0.5], [1, 2], 0.3, sample=20).collect()
    assert len(runs) == 4 and all(r.rel_spectral_error <= r.rel_frobenius_error * 20 for r in runs)
    error = lambda x: max(r.rel_frobenius_error for r in runs if r.m_ratio == x)
    assert error(0.5) < error(0.1)
    by_ratio = spark.read.option("header", True).csv(str(tmp_path / "by_ratio"))
    for row in by_ratio.collect():
        own = [r.auc for r in runs if r.m_ratio == float(row.m_ratio)]
        mean = sum(own) / len(own)
        assert (float(row.auc_mean), float(row.auc_std)) == pytest.approx((mean, (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5))
    assert {"auc_mean", "auc_std"} <= set(by_ratio.columns) and by_ratio.count() == 2
    assert spark.read.text(str(tmp_path / "recommendation")).count() == 2


def test_overlap_against_a_saved_reference(spark, reads, tmp_path):
    own, test = KERNEL.features(reads.filter("label = 1")).cache(), KERNEL.features(reads).cache()
    w = KERNEL.by_k
    curve = experiments.build_reference(kernels.normalise(kernels.gram(own, w), kernels.diagonal(own, w)), str(tmp_path / "ref"), 64)
    cross = kernels.normalise(kernels.cross_gram(test, own, w), kernels.diagonal(test, w), kernels.diagonal(own, w))
    oas, area = experiments.evaluate_overlap(cross, curve, reads.select("patient", "label").distinct(), 64)
    rows = oas.collect()
    assert len(rows) == 6 and all(r.anomaly_score == pytest.approx(1 - r.oa) for r in rows)
    assert (area.first().n_pos, area.first().n_neg) == (3, 3)
    pos, neg = ([r.anomaly_score for r in rows if (r.label == -1) == tumor] for tumor in (True, False))
    assert area.first().auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 9)


def test_overlap_of_embeddings(spark):
    r = random.Random(6)
    e = spark.createDataFrame([(f"p{i % 4}", i, [r.gauss(i % 4, 1.0) for _ in range(5)]) for i in range(40)], "patient string, id long, embedding array<float>")
    own = e.filter("patient < 'p2'")
    for kind in ("rbf", "linear"):
        curve = pipelines.reference_curve(experiments.embedding_distances(own, own, kind), 32)
        oas, _ = experiments.evaluate_overlap(experiments.embedding_distances(e, own, kind), curve, e.select("patient", F.when(F.col("patient") < "p2", 1).otherwise(-1).alias("label")).distinct(), 32)
        assert oas.count() == 4


def test_validate_reference(spark, tmp_path):
    r = random.Random(7)
    scores = spark.createDataFrame([(f"s{i % 3}", 1, r.gauss(i % 3, 1)) for i in range(60)], "subject string, label int, score double")
    full = {(x.a, x.b): x.oa for x in experiments.validate_reference(scores, str(tmp_path), 256).collect()}
    assert len(full) == 9 and full["s0", "s0"] == 1 and full["s0", "s1"] == full["s1", "s0"] > full["s0", "s2"]
    assert spark.read.json(str(tmp_path / "report")).count() == 3
    typed = spark.createDataFrame([("healthy_vs_healthy", 0.8), ("healthy_vs_tumor", 0.5)], "comparison_type string, oa double")
    assert density.group_delta(typed).first().delta == pytest.approx(0.3)


def test_own_aggregator(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "subject string, score double")
    statistics.register_aggregator("spread", lambda v: F.max(v) - F.min(v))
    try:
        got = {r.aggregator: r.value for r in statistics.aggregate_all(df, ["subject"]).collect()}
        assert got["spread"] == 2.0 and got["mean"] == 2.0
        with pytest.raises(ValueError):
            statistics.register_aggregator("max", F.max)
    finally:
        del statistics.AGGREGATORS["spread"]


def test_value_at_rank(spark):
    r = random.Random(8)
    values = [r.choice([r.gauss(0, 1), 1.0, -3.0, 1e6]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    order = sorted(values)
    for rank in (0, 5, 1499, 2999):
        v, below, equal = statistics.value_at_rank(df, "v", rank, 3000, held=50, bins=16)
        assert v == order[rank] and below == sum(x < v for x in values) and equal == values.count(v)
    assert statistics.quantiles(df.limit(0), "v", {"x": 0.5}).first().x is None


def test_flat_scores_have_a_survival_curve(spark):
    flat = spark.createDataFrame([("a", 2.0)] * 3, "subject string, score double")
    assert {x.survival for x in density.survival(flat, ["subject"], 5).collect()} == {0.0}


def test_letters_beyond_the_alphabet(spark):
    df = spark.createDataFrame([("p", 0, "CNAN"), ("p", 1, "AHAH"), ("p", 2, "CNAA")], "patient string, read_idx long, seq string")
    from helixframe.operators import features

    g = {(r.i.read_idx, r.j.read_idx): r.k for r in kernels.gram(features.weighted_features(df, 3, 0), {3: 1.0}).collect()}
    assert g == {(0, 0): 2, (0, 1): 0, (0, 2): 1, (1, 1): 2, (1, 2): 0, (2, 2): 2}
    assert sampling.landmarks(df, 2).count() == 2 and nystrom.landmark_count(0.01, 300) == 3


def test_overlap_runs_end_in_files(spark, reads, tmp_path):
    own, test = reads.filter("label = 1 AND patient <> 'Healthy_2'"), reads.filter("label = -1 OR patient = 'Healthy_2'")
    first = experiments.overlap_experiment(test, str(tmp_path / "a"), own=own, kernel=KERNEL, points=64).first()
    again = experiments.overlap_experiment(test, str(tmp_path / "b"), reference=str(tmp_path / "a/reference")).first()
    assert (first.n_pos, first.n_neg) == (3, 1) and first == again
    patients = spark.read.option("header", True).csv(str(tmp_path / "b/patients"), inferSchema=True).collect()
    pos, neg = ([r.anomaly_score for r in patients if (r.label == -1) == t] for t in (True, False))
    assert first.auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 3)
    with pytest.raises(ValueError):
        experiments.overlap_experiment(test, str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        experiments.overlap_experiment(test, str(tmp_path / "c"), reference=str(tmp_path / "none"))


def test_embedding_runs_end_in_files(spark, tmp_path):
    r = random.Random(6)
    e = spark.createDataFrame([(f"p{i % 4}", 1 if i % 4 < 3 else -1, i, [r.gauss(2 * (i % 4 == 3), 1.0) for _ in range(5)]) for i in range(60)], "patient string, label int, id long, embedding array<float>")
    own, test = e.filter("patient < 'p2'").drop("label"), e.filter("patient >= 'p2'")
    a = experiments.embedding_overlap_experiment(own, test, str(tmp_path / "o"), points=32).first()
    b = experiments.embedding_experiment(own.select("id", "embedding"), test, str(tmp_path / "m")).first()
    assert (a.n_pos, a.n_neg, b.n_pos, b.n_neg) == (1, 1, 1, 1) and b.auc == 1.0
    patients = {r.patient: r for r in spark.read.option("header", True).csv(str(tmp_path / "m/patients"), inferSchema=True).collect()}
    scores = spark.read.option("header", True).csv(str(tmp_path / "m/scores"), inferSchema=True).collect()
    for p, row in patients.items():
        own_scores = [x.anomaly_score for x in scores if x.patient == p]
        assert (row.n_sequences, row.mean_score) == (15, pytest.approx(sum(own_scores) / 15))


def test_seed_stability_resumes(spark, reads, tmp_path):
    options = dict(own=["Healthy_0"], a="Healthy_1", b="Healthy_2", max_train=8, max_test=10, nu=0.3)
    experiments.seed_stability(reads, KERNEL, str(tmp_path), seeds=[1], **options)
    before = set(spark.read.parquet(str(tmp_path / "results")).inputFiles())
    rows = {r.train_seed: r for r in experiments.seed_stability(reads, KERNEL, str(tmp_path), seeds=[1, 2], **options).collect()}
    assert set(rows) == {1, 2} and before < set(spark.read.parquet(str(tmp_path / "results")).inputFiles())
    assert all((r.n_train, r.n_test_a, r.n_test_b) == (8, 10, 10) for r in rows.values())
    wide = spark.read.option("header", True).csv(str(tmp_path / "anomaly_scores/seed2_scores"), inferSchema=True).toPandas()
    assert (wide["Healthy_1"].mean(), wide["Healthy_2"].mean()) == pytest.approx((rows[2].mean_score_a, rows[2].mean_score_b))
    train = sampling.stratified(reads.filter("patient = 'Healthy_0'"), 8, 1, 2)
    test = sampling.stratified(reads.filter("patient IN ('Healthy_1', 'Healthy_2')"), 20, 2, 42)
    alone = pipelines.exact_scores(train, test, KERNEL, 0.3).groupBy("patient").agg(F.avg(-F.col("decision")).alias("m")).collect()
    assert {r.patient: r.m for r in alone} == pytest.approx({"Healthy_1": rows[2].mean_score_a, "Healthy_2": rows[2].mean_score_b}, abs=5e-3)
    summary = spark.read.option("header", True).csv(str(tmp_path / "summary"), inferSchema=True).first()
    assert summary["mean"] == pytest.approx((rows[1].oa + rows[2].oa) / 2) and summary["n"] == 2
    with pytest.raises(ValueError):
        experiments.seed_stability(reads, KERNEL, str(tmp_path), seeds=[3], **(options | {"a": "nobody"}))


def test_reference_stability(spark, reads, tmp_path):
    full = {(r.a, r.b): r.oa for r in experiments.reference_stability(reads, KERNEL, str(tmp_path), size=2, combinations=3, max_train=12, points=64).collect()}
    assert len(full) == 9 and all(full[a, b] == full[b, a] and 0 < full[a, b] <= 1.0001 for a, b in full)
    assert spark.read.json(str(tmp_path / "report")).count() == 3
    drawn = [tuple(r.members) for r in sampling.combinations(reads.filter("label = 1").select("patient").distinct(), 2, 3).collect()]
    assert sorted(drawn) == [("Healthy_0", "Healthy_1"), ("Healthy_0", "Healthy_2"), ("Healthy_1", "Healthy_2")]


def test_names_of_files(spark):
    paths = [("/a/LOO_Healthy_3/Colo_11_scores_seed42.csv", 1), ("/a/LOO_Healthy_4/Healthy_4_scores_seed42.csv", 7)]
    df = spark.createDataFrame(paths, "path string, modified long")
    assert {(r.f, r.s) for r in df.select(score_tables.fold_of(F.col("path")).alias("f"), score_tables.subject_of(F.col("path")).alias("s")).collect()} == {("Healthy_3", "Colo_11"), ("Healthy_4", "Healthy_4")}
    assert score_tables.latest(df).first().path == paths[1][0]
