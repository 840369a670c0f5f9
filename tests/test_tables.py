"""FASTA and score files, model folders, sampling, and statistics with ties and empty classes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import statistics
from helixframe.operators import density, reports, sampling
from helixframe.sources import fasta, model_store, score_tables

from .test_sequences import frame


def reads(spark, n=50, patients=("a", "b")):
    return spark.createDataFrame([(p, i, 1, "acgt") for p in patients for i in range(n)] + [("a", 1000, 1, None)], "patient string, read_idx long, label int, seq string")


def test_fasta(spark, tmp_path):
    (tmp_path / "Healthy_1_merged.fa").write_text(">r1 x\nACG\nTTa\n>r2\r\nGG\r\n\r\n>empty\n>r3\nM\n")
    (tmp_path / "Colo_2_merged.fa").write_text(">q1\nHHH\n")
    rows = fasta.read_fasta(spark, str(tmp_path))
    got = sorted((r.patient, r.read_idx, r.name, r.seq) for r in rows.collect())
    assert got == [("Colo_2", 0, "q1", "HHH"), ("Healthy_1", 0, "r1 x", "ACGTTA"), ("Healthy_1", 1, "r2", "GG"), ("Healthy_1", 3, "r3", "M")]
    wanted = spark.createDataFrame([("Healthy_1", 1), ("Healthy_1", 99)], "patient string, read_idx long")
    assert [r.seq for r in fasta.get_reads(rows, wanted).collect()] == ["GG"]
    assert {r.length for r in fasta.fasta_index(rows).collect()} == {3, 6, 2, 1}
    audit = {r.symbol: (r.status, r.n_reads) for r in fasta.symbol_audit(frame(spark, ["ACGX", "A"])).collect()}
    assert audit["A"] == ("present", 2) and audit["X"] == ("unexpected", 1) and audit["U"] == ("missing", 0)


def test_score_files(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.5), (2, 2, 2.5)], "round int, read_idx long, score double")
    score_tables.write_rounds(s, [1, 2], str(tmp_path / "Colo_11_scores_seed42.csv"))
    part = next((tmp_path / "Colo_11_scores_seed42.csv").glob("part-*.csv"))
    (tmp_path / "x").mkdir()
    part.rename(tmp_path / "x" / "Colo_11_scores_seed42.csv")
    back = score_tables.read_rounds(spark, str(tmp_path / "x")).collect()
    assert sorted((r.subject, r.round, r.score) for r in back) == [("Colo_11", 1, 0.5), ("Colo_11", 1, 1.5), ("Colo_11", 2, 2.5)]
    names = spark.createDataFrame([("Colo_2", -1), ("Healthy_10", 1), ("Healthy_9", 1), ("Healthy", 1)], "n string, l int")
    assert [r.n for r in names.orderBy(*score_tables.natural_order(F.col("n"), F.col("l"))).collect()] == ["Healthy_9", "Healthy_10", "Healthy", "Colo_2"]
    assert [r[0] for r in names.select(score_tables.subject_class(F.col("n"))).collect()] == ["tumor", "healthy", "healthy", "healthy"]


def test_summary_append_is_idempotent(spark, tmp_path):
    row = lambda fold, x: spark.createDataFrame([(fold, x)], "fold string, mean double")
    for fold, x in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        score_tables.append_summary(row(fold, x), str(tmp_path / "s"))
    assert sorted((r.fold, r["mean"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 3.0), ("b", 2.0)]


def test_model_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, 0.1 + 0.2)], "id long, alpha double")
    model_store.save_model(spark, str(tmp_path / "m"), {"rho": 0.25, "max_k": 3}, {"alpha": t})
    params, tables = model_store.load_model(spark, str(tmp_path / "m"))
    assert params["rho"] == 0.25 and params["backend"] == "precomputed" and tables["alpha"].collect() == t.collect()
    with pytest.raises(ValueError):
        model_store.load_model(spark, str(tmp_path / "m"), "nystrom")


def test_sampling(spark):
    r = reads(spark)
    one, two = (sampling.stratified(r, 21, 2, seed).collect() for seed in (1, 1))
    assert one == two and len(one) == 20 and all(x.seq == "ACGT" for x in one)
    assert len(sampling.stratified(r, 10_000, 2).collect()) == 100
    used = sampling.stratified(r, 40, 2)
    rounds = sampling.disjoint_rounds(r, 3, 10, 5, used).collect()
    keys = [(x.patient, x.read_idx) for x in rounds]
    assert len(keys) == len(set(keys)) == 60 and not {(x.patient, x.read_idx) for x in used.collect()} & set(keys)
    assert {x.round for x in rounds} == {1, 2, 3}
    with pytest.raises(ValueError):
        sampling.disjoint_rounds(r, 4, 10, 5, used)
    c = sampling.cohort(r, {"train": (["a"], 5), "test": (["b"], 7)})
    assert {x.split: x["count"] for x in c.groupBy("split").count().collect()} == {"train": 5, "test": 7}
    p = spark.createDataFrame([(x,) for x in "abcd"], "patient string")
    assert sampling.combinations(p, 3, 10).count() == 4


def test_auc_ties_and_empty_classes(spark):
    rows = [(1, -1, 2.0), (1, -1, 1.0), (1, 1, 1.0), (1, 1, 0.0), (2, 1, 1.0)]
    df = spark.createDataFrame(rows, "g int, label int, v double")
    got = {r.g: r.auc for r in statistics.auc(df, "v", F.col("label") == -1, ["g"]).collect()}
    assert got == {1: 0.875, 2: None}
    assert statistics.auc_of_reads(df.filter("g = 1"), "v", F.col("label") == -1).first().auc == 0.875
    r = random.Random(1)
    big = [(1, r.choice((-1, 1)), r.choice(range(20)) / 4) for _ in range(400)]
    pos, neg = [v for _, y, v in big if y == -1], [v for _, y, v in big if y == 1]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    df = spark.createDataFrame(big, "g int, label int, v double").repartition(5)
    assert statistics.auc(df, "v", F.col("label") == -1, ["g"]).first().auc == pytest.approx(want)
    assert statistics.auc_of_reads(df, "v", F.col("label") == -1).first().auc == pytest.approx(want)
    assert statistics.auc(df.limit(0), "v", F.col("label") == -1, ["g"]).count() == 0


def test_held_out_areas(spark):
    rows = [(i, y, v) for i, (y, v) in enumerate([(1, 1.0), (1, 3.0), (-1, 1.0), (-1, 2.0), (-1, 3.0)])]
    df = spark.createDataFrame(rows, "subject int, label int, value double").withColumn("c", F.lit(1))
    assert {r.subject: r.auc for r in reports.auc_units(df, ["c"], True).collect()} == pytest.approx({0: 2.5 / 3, 1: 0.5 / 3})


def test_aggregators(spark):
    x = [float(i % 17) for i in range(60)]
    df = spark.createDataFrame([(1, v) for v in x], "g int, score double")
    got = {r.aggregator: r.value for r in statistics.aggregate_all(df, ["g"], tops=(5, 500)).collect()}
    want = {"max": max(x), "mean": np.mean(x), "median": np.median(x), "p90": np.percentile(x, 90), "p95": np.percentile(x, 95), "p99": np.percentile(x, 99), "top5": np.mean(sorted(x)[-5:]), "top500": np.mean(x)}
    assert got == pytest.approx(want)


def test_overlap_of_equal_and_distant_subjects(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=200)
    rows = [(s, float(v)) for s, x in (("a", base), ("b", base), ("c", base + 50)) for v in x]
    df = spark.createDataFrame(rows, "subject string, score double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = {(x.a, x.b): x.oa for x in density.oa_pairs(df, pairs).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "c"] < 0.02
    flat = spark.createDataFrame([("a", 1.0), ("a", float("nan"))], "subject string, score double")
    assert np.isfinite([x.y for x in density.curve(flat, ["subject"], "score", 8).collect()]).all()


def test_survival_counts_strictly_above(spark):
    x = [0.0, 0.25, 0.5, 0.5, 1.0]
    df = spark.createDataFrame([(1, v) for v in x], "g int, score double")
    got = {r.t_i: (r.t, r.survival) for r in density.survival(df, ["g"], 5).collect()}
    assert got == {i: (i / 4, np.mean([v > i / 4 for v in x])) for i in range(5)}


def test_recommendation(spark):
    runs = spark.createDataFrame([(0.01, 0.5, 0.9), (0.02, 0.55, 0.99), (0.05, 0.55, 0.99)], "m_ratio double, auc double, spearman_corr double")
    assert reports.recommend(runs, 0.56).first().m_ratio == 0.02


def test_baseline_curves_and_downsampling(spark):
    r = np.random.default_rng(1)
    rows = [(s, y, i, float(v)) for s, y in (("a", 1), ("b", 1), ("t", -1)) for i, v in enumerate(r.normal(size=30))]
    df = spark.createDataFrame(rows, "subject string, label int, read_idx long, score double")
    got = density.baseline_curves(df, 50).collect()
    assert {(x.subject, x.curve) for x in got} == {(s, c) for s in "abt" for c in ("own", "baseline")} and len(got) == 300
    pool = np.array([v for s, y, _, v in rows if y == 1])
    x = next(x for x in got if (x.subject, x.curve, x.grid_i) == ("t", "baseline", 25))
    h = pool.std(ddof=1) * len(pool) ** -0.2
    assert x.y == pytest.approx(np.exp(-0.5 * ((x.x - pool) / h) ** 2).mean() / (h * np.sqrt(2 * np.pi)))
    assert sampling.downsample(df, ["subject"], "read_idx", 7).groupBy("subject").count().select("count").distinct().collect() == [(7,)]


def test_running_sums_and_youden_against_plain_versions(spark):
    from helixframe.functions.statistics import running_before

    n = 5000
    values = [((i * 7919) % n / 7.0, 1 + i % 5) for i in range(n)]
    df = spark.createDataFrame(values, "v double, c long").repartition(7)
    total, want = 0, {}
    for v, c in sorted(values):
        want[v] = total
        total += c
    assert {r.v: r.before_c for r in running_before(df, "v", ["c"]).collect()} == want
    assert running_before(df.limit(0), "v", ["c"]).count() == 0

    rows = [(-1, 3.0), (-1, 2.0), (-1, 2.0), (1, 2.0), (1, 1.0), (1, 0.5)]
    best = reports.youden(spark.createDataFrame(rows, "label int, value double")).first()
    assert (best.threshold, round(best.tpr, 6), round(best.fpr, 6)) == (2.0, 1.0, 0.333333)
    one_class = reports.youden(spark.createDataFrame([(1, 1.0)], "label int, value double")).first()
    assert one_class.tpr is None and one_class.fpr == 1.0


def test_keyed_ranks_aggregates_and_samples_against_plain_versions(spark):
    from helixframe.functions import statistics

    r = np.random.default_rng(4)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}", int(r.integers(2)), float(r.choice([0.5, 1.5, r.normal()])), float(r.integers(4)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, label int, a double, b double, read_idx long").repartition(6)
    by = {}
    for k, *x in rows:
        by.setdefault(k, []).append(x)
    rank = lambda x: np.array([np.mean(np.flatnonzero(np.sort(x) == v)) + 1 for v in x])
    got = {x.k: (x.spearman, x.n) for x in statistics.spearman(df, "a", "b", ["k"]).collect()}
    assert set(got) == set(by)
    for k, x in by.items():
        a, b = (np.array([v[c] for v in x]) for c in (1, 2))
        assert got[k] == (pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1]), len(x))
    whole = np.array([x[2] for x in rows])
    assert statistics.spearman(df, "a", "b").first().spearman == pytest.approx(np.corrcoef(rank(whole), rank(np.array([x[3] for x in rows])))[0, 1])
    areas = {x.k: (x.auc, x.n_pos, x.n_neg) for x in statistics.auc(df, "a", F.col("label") == 1, ["k"]).collect()}
    for k, x in by.items():
        pos, neg = ([v[1] for v in x if v[0] == c] for c in (1, 0))
        assert areas[k] == (pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])), len(pos), len(neg))
    values = {(x.k, x.aggregator): x.value for x in statistics.aggregate_all(df, ["k"], "a", (3, 10_000)).collect()}
    for k, x in by.items():
        a = np.sort([v[1] for v in x])
        want = {"max": a[-1], "mean": a.mean(), "top3": a[-3:].mean(), "top10000": a.mean(), **{n: np.quantile(a, q) for n, q in statistics.QUANTILES.items()}}
        assert {n: values[k, n] for n in want} == pytest.approx(want)
    q = statistics.quantiles(df, "a", {"x": 0.37, "y": 1.0}).first()
    assert (q.x, q.y) == pytest.approx((np.quantile(whole, 0.37), whole.max()))
    assert statistics.quantiles(df.limit(0), "a", {"x": 0.5}).first().x is None


def test_samples_are_the_least_digests(spark):
    import hashlib

    rows = [(s, r, i, float(i)) for s in ("a", "b|", None) for r in (1, 2) for i in range(40)] + [("one", 1, 7, 0.0)]
    df = spark.createDataFrame(rows, "subject string, round int, read_idx long, score double").repartition(5)
    got = {}
    for x in sampling.subsample_scores(df, [3, 25, 100], ["subject", "round"], 2).collect():
        got.setdefault((x.subject, x.round, x.n_reads, x.rep), []).append(x.read_idx)
    for s, r in {x[:2] for x in rows}:
        for n in (3, 25, 100):
            for rep in (1, 2):
                digest = lambda i: hashlib.md5("|".join(str(v) for v in (42, rep, n, s, r, i) if v is not None).encode()).hexdigest()  # noqa: B023, E731
                ids = sorted((x[2] for x in rows if x[:2] == (s, r)), key=lambda i: (digest(i), i))[:n]
                assert sorted(got[s, r, n, rep]) == sorted(ids)


def test_tails_and_fold_overlay(spark):
    r = np.random.default_rng(5)
    rows = [(s, y, i, float(v)) for s, y, m in (("a", 1, 0), ("b", 1, 0), ("t", -1, 1), ("u", -1, 2)) for i, v in enumerate(r.normal(m, 1, 40))]
    df = spark.createDataFrame(rows, "subject string, label int, read_idx long, score double")
    healthy, every = (np.array([x[3] for x in rows if x[1] == 1 or y]) for y in (False, True))
    got = density.tail_zoom(df, points=20).collect()
    assert len(got) == 2 * 6 * 20
    lo, hi = np.quantile(healthy, 0.95), every.max()
    right = [x for x in got if x["tail"] == "right" and x.subject is None and x.label == -1]
    pool = np.array([x[3] for x in rows if x[1] == -1])
    h = pool.std(ddof=1) * len(pool) ** -0.2
    assert (min(x.x for x in right), max(x.x for x in right)) == pytest.approx((lo - 0.05 * (hi - lo), hi + 0.05 * (hi - lo)))
    assert all(x.y == pytest.approx(np.exp(-0.5 * ((x.x - pool) / h) ** 2).mean() / (h * np.sqrt(2 * np.pi))) for x in right)
    curves = density.fold_overlay(df, 10).collect()
    assert {(x.fold, x.subject) for x in curves} == {(f"LOO_{f}", s) for f in "ab" for s in (f, "t", "u")} and len(curves) == 60
    one = [x for x in curves if (x.fold, x.subject) == ("LOO_b", "u")]
    own = np.array([x[3] for x in rows if x[0] == "u"])
    ends = np.array([x[3] for x in rows if x[0] in "btu"])
    assert (min(x.x for x in one), max(x.x for x in one), one[0].mean_score) == pytest.approx((ends.min(), ends.max(), own.mean()))


def test_downsampled_curve(spark):
    df = spark.createDataFrame([("k", i, float(i % 10)) for i in range(200)], "k string, id long, d double")
    a, b = (density.curve(df.repartition(n), ["k"], "d", 16, most=30, ident="id").orderBy("grid_i").collect() for n in (2, 5))
    assert [x.y for x in a] == pytest.approx([x.y for x in b]) and len(a) == 16


def test_wide_table_of_ragged_columns(spark):
    rows = [("x", i, float(i)) for i in (9, 4, 7)] + [("y", 1, 5.0)]
    wide = score_tables.widen(spark.createDataFrame(rows, "c string, read_idx long, score double").repartition(3), "c", ["x", "y"]).orderBy("row").collect()
    assert [tuple(r) for r in wide] == [(0, 4.0, 5.0), (1, 7.0, None), (2, 9.0, None)]


def test_files_of_patients(spark):
    assert {(r.patient, r.num_sequences) for r in sampling.files_info(reads(spark, 4)).collect()} == {("a", 5), ("b", 4)}


def test_spearman_where_one_side_has_equal_values_only(spark):
    rows = [("one", 1.0, 8), ("flat", 1.0, 9), ("flat", 2.0, 9), ("both", 1.0, 8), ("both", 1.0, 8), ("varied", 1.0, 8), ("varied", 2.0, 9), ("varied", 3.0, 9)]
    df = spark.createDataFrame(rows, "k string, a double, b int")
    got = {x.k: (x.spearman, x.n) for x in statistics.spearman(df, "a", "b", ["k"]).collect()}
    want = {"one": (np.nan, 1), "flat": (np.nan, 2), "both": (np.nan, 2), "varied": (3**0.5 / 2, 3)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)
    whole = statistics.spearman(df.limit(0), "a", "b").first()
    assert whole.spearman is None and whole.n == 0


def test_spearman_of_equal_values_in_many_partitions(spark):
    # deviations of 28 equal ranks, merged from partitions of 7, are not zero
    rows = [(k, i if k else -i, 9 if k % 2 else i, i % 4) for k in range(40) for i in range(28)]
    spread = spark.createDataFrame(rows, "k int, a int, b int, p int").repartitionByRange(4, "p")
    assert {x.k % 2: np.isnan(x.spearman) for x in statistics.spearman(spread, "a", "b", ["k"]).collect()} == {0: False, 1: True}
    ends = {x.k: x.spearman for x in statistics.spearman(spread.filter("k in (0, 2)"), "a", "b", ["k"]).collect()}
    assert ends == {0: -1.0, 2: 1.0}


def test_spearman_ranks_nulls_last(spark):
    import duckdb

    rows = [(k, None if (i + k) % 5 == 0 else float((i * 7) % 11), None if i % 7 == 0 else i % 4) for k in range(3) for i in range(30)]
    got = {x.k: x.spearman for x in statistics.spearman(spark.createDataFrame(rows, "k int, a double, b int"), "a", "b", ["k"]).collect()}
    c = duckdb.connect()
    c.sql("CREATE TABLE s (k INT, a DOUBLE, b INT)")
    c.executemany("INSERT INTO s VALUES (?, ?, ?)", rows)
    rank = "rank() OVER (PARTITION BY k ORDER BY {0}) + (count(*) OVER (PARTITION BY k, {0}) - 1) / 2.0"
    assert got == pytest.approx(dict(c.sql(f"WITH r AS (SELECT k, {rank.format('a')} AS ra, {rank.format('b')} AS rb FROM s) SELECT k, corr(ra, rb) FROM r GROUP BY k").fetchall()))
