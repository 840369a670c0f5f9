"""Steps that must not grow faster than their input, against plain versions, with parts small enough that many of them meet."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import statistics
from helixframe.operators import cohorts, density, distances, features, kernels, nystrom, ocsvm, reports, sampling
from helixframe.plans import pipelines

from .test_solver import _rbf


def test_bootstrap_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(reports, "PART", 4)
    monkeypatch.setattr(reports, "BLOCK", 8)
    r = np.random.default_rng(3)
    rows = [(i, -1 if i % 3 == 0 else 1, float(r.integers(0, 12))) for i in range(70)]
    got = reports.bootstrap_auc(spark.createDataFrame(rows, "subject int, label int, value double"), 40).first()
    own = {x: sorted(v for _, label, v in rows if label == x) for x in (1, -1)}
    areas = []
    for rep in range(1, 41):
        h, t = (np.array([own[x][int(hashlib.md5(f"42|{rep}|{x}|{k}".encode()).hexdigest()[:8], 16) % len(own[x])] for k in range(len(own[x]))]) for x in (1, -1))
        areas.append(np.mean((t[:, None] > h) + (t[:, None] == h) / 2))
    assert (got.low, got.median, got.high) == pytest.approx(tuple(np.quantile(areas, [0.025, 0.5, 0.975])))
    one_class = spark.createDataFrame(rows, "subject int, label int, value double").filter("label = 1")
    assert reports.bootstrap_auc(one_class, 5).first().low is None and reports.bootstrap_auc(one_class.limit(0), 5).first().low is None


@pytest.mark.parametrize("hot", [7, 65_536])
def test_sampled_aggregates_are_those_of_the_samples(spark, monkeypatch, hot):
    monkeypatch.setattr(sampling, "HOT", hot)
    r = np.random.default_rng(4)
    rows = [(s, 1 + i % 2, -1 if s == "b" else 1, i, None if i % 9 == 0 else float(r.integers(0, 30)) / 7) for s in ("a", "b", None) for i in range(60)] + [("nulls", 1, 1, 0, None), ("one", 1, 1, 0, 2.0)]
    df = spark.createDataFrame(rows, "subject string, round int, label int, read_idx long, score double").repartition(3)
    keys = ["subject", "round"]
    cell = [*keys, "label", "n_reads", "rep", "aggregator"]
    got = {tuple(x[c] for c in cell): x.value for x in sampling.sampled_aggregates(df, [4, 20, 100], keys, 2, tops=(3, 500)).collect()}
    samples = sampling.subsample_scores(df, [4, 20, 100], keys, 2)
    plain = {tuple(x[c] for c in cell): x.value for x in statistics.aggregate_all(samples, cell[:-1], tops=(3, 500)).collect()}
    assert got == pytest.approx(plain) and len(got) == 8 * 2 * (3 * 2 * 3 + 3)
    # scores are dealt out once: their number in the shuffle does not grow with sizes and repetitions
    plan = sampling.sampled_aggregates(df, [4, 20, 100], keys, 2)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_distances_are_added_up_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(kernels, "WIDE", 9)
    monkeypatch.setattr(kernels, "TILE", 4)
    r = np.random.default_rng(6)
    reads = spark.createDataFrame([(p, i, "".join(r.choice(list("ACGT"), 12))) for i in range(40) for p in ["bac"[i % 3]]], "patient string, read_idx long, seq string")
    f, w = features.read_vectors(reads, [2, 3], 1).cache(), {2: 0.4, 3: 0.6}
    plain = kernels.normalise(kernels.gram(f, w), kernels.diagonal(f, w)).cache()
    pairs = {(x.i, x.j): x.k for x in kernels.gram(f, w, 16, cosine=True).collect()}
    assert pairs == pytest.approx({(x.i, x.j): x.k for x in plain.collect()})
    own = {}
    for (i, j), k in pairs.items():
        if i != j:
            own.setdefault((i.patient, j.patient), []).append(np.sqrt(max(0, 2 * (1 - k))))
    got = {(x.i, x.j): (x.n, x["mean"], x.nearest, x.farthest) for x in kernels.distance_sums(f, w).collect()}
    assert set(got) == set(own)
    for key, d in own.items():
        assert got[key] == pytest.approx((len(d), np.mean(d), min(d), max(d)), abs=1e-7)
    state = nystrom.fit(reads, f, w, 5)
    phi = nystrom.transform(f, state, reads=reads)
    assert tuple(nystrom.map_errors(f, phi, w).first()) == pytest.approx(tuple(nystrom.intrinsic_errors(plain, phi).first()), abs=1e-9)


def test_many_reads_bring_no_kernel_rows_to_the_driver(spark, monkeypatch):
    rows, k = _rbf(spark, 300, 4)
    monkeypatch.setattr(rows, "rows", None)
    got, want = ocsvm._solve_many(rows, 0.3, 1e-4, 1000, 48), ocsvm.solve(k, 0.3, 1e-4)
    g = k @ got.alpha
    assert got.alpha.sum() == pytest.approx(90) and got.rho == pytest.approx(want.rho, abs=1e-3)
    assert g[got.alpha > 0].max() - g[got.alpha < 1].min() < 2e-4


def test_fold_overlay_makes_a_tumor_curve_once_a_grid(spark, monkeypatch):
    rows = [(s, -1 if s > 9 else 1, float(i + s % 3 + (0 if s > 9 else 1))) for s in range(14) for i in range(0, 20, 1 if s > 9 else 3)]
    df, laid, whole = spark.createDataFrame(rows, "subject int, label int, score double"), [], density.gaussian_density
    monkeypatch.setattr(density, "gaussian_density", lambda points, grids, *rest: (laid.append(grids.count()), whole(points, grids, *rest))[1])
    got = density.fold_overlay(df, 6).collect()
    assert len(got) == 10 * 5 * 6 and sum(laid) == 10 + 4


def _plain_overlap(x, y, points):
    lo, hi = min(min(x), min(y)), max(max(x), max(y))
    start, top = lo - 0.1 * (hi - lo), 1.1 * max(abs(lo), abs(hi))
    grid, sides = start + np.arange(points) * (top - start) / (points - 1), []
    for v in (np.array(x), np.array(y)):
        h = (1e-6 if len(v) < 2 or v.min() == v.max() else v.std(ddof=1)) * len(v) ** -0.2
        sides.append(np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi)))
    return 1 - np.trapezoid(np.abs(sides[0] - sides[1]), grid) / 2


def test_overlaps_meet_as_polynomials(spark, monkeypatch):
    monkeypatch.setattr(density, "CHUNK", 8)
    monkeypatch.setattr(density, "SUBJECTS", 3)
    r = np.random.default_rng(9)
    own = {f"s{i}": [float(v) for v in np.round(r.exponential(3 + i, 10 + 5 * i) - i, 2)] for i in range(9)} | {"far": [0.0, 1.0, 2.0, 5000.0], "many": [1.0] * 40 + [2.0]}
    label = {s: -1 if i % 4 == 3 else 1 for i, s in enumerate(own)}
    rows = [(s, label[s], v) for s, x in own.items() for v in [*x, None, float("nan")]] + [(None, 1, 1.0)]
    df = spark.createDataFrame(rows, "subject string, label int, score double")
    want = {(a, b, label[b] == -1): _plain_overlap(own[a], own[b], 200) for a in own for b in own if label[a] == 1 and (label[b] == -1 or a < b)}
    got = {(x.a, x.b, x.tumor): x.oa for x in density.oa_all(df, points=200).collect()}
    assert got == pytest.approx(want, abs=1e-10)
    healthy = {(x.a, x.b): x.oa for x in density.oa_all(df, False, 200).collect()}
    assert healthy == pytest.approx({k[:2]: v for k, v in want.items() if not k[2]}, abs=1e-10)
    pairs = spark.createDataFrame([k[:2] for k in want], "a string, b string")
    one_by_one = density.oa_pairs(df, pairs, 200)
    assert {(x.a, x.b): x.oa for x in one_by_one.collect()} == pytest.approx({k[:2]: v for k, v in want.items()}, abs=1e-10)
    assert "grid_i" not in one_by_one._jdf.queryExecution().toString()
    assert density.oa_all(df.limit(0)).count() == 0 and density.oa_pairs(df.limit(0), pairs).count() == 0


def test_one_chunk_densities_need_no_row_a_point_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(statistics, "CHUNK", 16)
    monkeypatch.setattr(statistics, "NUMBERS", 40)
    r = np.random.default_rng(2)
    own = {s: np.round(r.normal(size=n), 3) for s, n in (("a", 5), ("b", 16), ("c", 100))}
    df = spark.createDataFrame([(s, float(v)) for s, x in own.items() for v in x], "subject string, score double")
    got = {}
    for x in density.curve(df, ["subject"], "score", 30, lo=F.lit(-2.0)).collect():
        got.setdefault(x.subject, {})[x.grid_i] = (x.x, x.y)
    for s, v in own.items():
        grid, h = np.linspace(-2, v.max(), 30), v.std(ddof=1) * len(v) ** -0.2
        y = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.array([got[s][i] for i in range(30)]) == pytest.approx(np.stack([grid, y], 1))


def test_features_of_short_strings_are_one_product(spark, monkeypatch):
    r = np.random.default_rng(8)
    seqs = ["".join(r.choice(list("ACGTMHNX"), r.integers(0, 30), p=[0.15] * 6 + [0.05] * 2)).encode() for _ in range(20)]
    calls = []
    monkeypatch.setattr(features.itertools, "combinations", lambda *x: calls.append(x) or [])
    dense = {(k, m, d): features.expanded(seqs, k, m, d) for k in (1, 2, 3) for m in range(1, k) for d in (0.5, 1.0)}
    assert not calls
    monkeypatch.undo()
    monkeypatch.setattr(features, "DENSE", 0)
    for key, got in dense.items():
        assert all(np.array_equal(x, y) for x, y in zip(got, features.expanded(seqs, *key)))


def test_neighbours_and_sums_without_a_shuffled_row_a_feature(spark):
    r = np.random.default_rng(5)
    rows = [("p", i, "".join(r.choice(list("ACGTMHNé" if i % 4 == 0 else "acGTMH"), 15))) for i in range(12)] + [("q", 1, None), ("q", 2, ""), ("q", 3, "AC")]
    df = spark.createDataFrame(rows, "patient string, read_idx long, seq string")
    want = {}
    for p, i, s in rows:
        for at in range(len(s or "") - 2):
            word = s.upper()[at : at + 3]
            for x in {word, *(word[:j] + a + word[j + 1 :] for j in range(3) for a in "ACGTMH")}:
                want[p, i, x] = want.get((p, i, x), 0) + 1
    assert {(x.patient, x.read_idx, x.kmer): x.cnt for x in features.mismatch_counts(df, 3, 1).collect()} == want
    plain = features.weighted_features(df, 4, 1).groupBy("patient", "read_idx").agg(F.count("*").alias("n"), F.sum("w").alias("t"), F.sum(F.col("w") * F.col("w")).alias("d"))
    sums = features.feature_sums(df, 4, 1)
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, plain.collect()))
    assert "Aggregate" not in sums._jdf.queryExecution().toString()


def test_shortest_vector_of_sums_over_many_reads(spark):
    """Sums over many reads are long and close together: a new one is still taken in, and the model of many reads ends after few passes."""
    r = np.random.default_rng(11)
    phi = r.exponential(size=(400, 12)) * np.exp(r.normal(size=12))
    phi /= np.linalg.norm(phi, axis=1)[:, None]
    times, n, nu = 10_000, 400, 0.2
    w = phi.sum(0) * nu * times
    atoms, share = w[None, :], np.ones(1)
    for _ in range(60):
        v = phi[np.argsort(phi @ w)[: int(nu * n)]].sum(0) * times
        if w @ (w - v) <= 1e-6 * (w @ w):
            break
        atoms, share = ocsvm._nearest_to_zero(np.vstack([atoms, v]), np.append(share, 0.0))
        w = share @ atoms
    assert w @ (w - v) <= 1e-6 * (w @ w)
    df = spark.createDataFrame([(x.tolist(),) for x in phi], "phi array<double>").crossJoin(spark.range(50)).select("phi")
    w, _ = ocsvm.fit_primal(df, nu, 60)
    v = phi[np.argsort(phi @ w)[: int(nu * n)]].sum(0) * 50
    assert w @ (w - v) <= 2e-6 * (w @ w)


def test_read_vectors_reach_workers_in_batches_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "256m")
        reads = spark.range(0, 9000, 1, 1).select(F.lit("p").alias("patient"), F.col("id").alias("read_idx"), F.expr("repeat(translate(cast(id as string), '0123456789', 'ACGTMHACGT'), 60)").alias("seq"))
        f = features.read_vectors(reads, [2, 3], 1)
        n = [r.n for r in f.coalesce(1).mapInArrow(_batch_bytes, "n bigint").collect()]
        assert sum(n) > 6 << 20 and max(n) < 6 << 20
        spark.conf.set(name, "1m")
        features.read_vectors(reads, [2, 3], 1)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def _batch_bytes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])


def test_folds_are_dealt_out_and_stored_in_short_cycles(spark, tmp_path):
    """Rows of all folds in one task, each patient's folds one after another, took 1.6 bytes a row."""
    rows = [(i, -1 if i % 3 == 0 else 1) for i in range(2100)]
    df = spark.createDataFrame(rows, "patient long, label int")
    cohorts.loo_folds(df.unionByName(df)).write.parquet(str(tmp_path / "folds"))
    files = sorted((tmp_path / "folds").glob("*.parquet"))
    got = spark.read.parquet(str(tmp_path / "folds"))
    n = got.count()
    assert n == 1400 * 2100 and sum(f.stat().st_size for f in files) < n
    assert len([f for f in files if f.stat().st_size > 10_000]) > 1
    assert {r.role: r.n for r in got.groupBy("role").agg(F.count("*").alias("n")).collect()} == {"tumor": 1400 * 700, "held_out": 1400, "train": 1400 * 1399}
    assert got.select("fold", "patient").distinct().count() == n
    assert {r.role for r in got.filter("fold = 'LOO_' || patient").collect()} == {"held_out"}


def test_pairs_of_blocks_meet_without_copies_in_the_shuffle(spark, monkeypatch):
    """Every row was shuffled once for each block of the other side."""
    monkeypatch.setattr(kernels, "BLOCK", 3)
    x = np.random.default_rng(8).normal(size=(23, 5))
    ids = [*range(20), 4, 4, 11]  # an id may occur more than once
    e = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, embedding array<double>")
    gamma = 0.3
    for kind in ("linear", "rbf"):
        k = kernels.embedding_product(x, x, kind, gamma)
        want = sorted((i, j, k[a, b]) for a, i in enumerate(ids) for b, j in enumerate(ids) if i <= j)
        pairs = kernels.embedding_kernel(e, kind=kind, gamma=gamma, block=4)
        got = sorted((r.i, r.j, r.k) for r in pairs.collect())
        assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
        both = kernels.embedding_kernel(e.filter("id < 9"), e, kind, gamma, 4)
        assert both.count() == 11 * 23 and "Generate" not in both._jdf.queryExecution().toString()
        assert "Generate" not in pairs._jdf.queryExecution().toString()
        alpha = e.withColumn("alpha", F.col("id") / 10).filter("id between 5 and 10")
        dots = {r.id: r.dot for r in kernels.embedding_sums(e.filter("id > 11"), alpha, kind, gamma, 4).collect()}
        assert dots == pytest.approx({i: sum(k[i, j] * j / 10 for j in range(5, 11)) for i in range(12, 20)})
    reads = spark.createDataFrame([("a", i, "ACGTMH"[i % 5 :] + "ACG") for i in range(12)], "patient string, read_idx long, seq string")
    f = features.read_vectors(reads, [3], 1)
    for g, n in ((kernels.gram(f, {3: 1.0}, 2), 78), (kernels.cross_gram(f, f, {3: 1.0}, 2), 144)):
        assert g.select("i", "j").distinct().count() == g.count() == n
        assert "FlatMapGroupsInArrow" not in g._jdf.queryExecution().toString()


def test_gradient_of_embeddings_in_one_pass(spark, monkeypatch):
    """Support vectors went through the driver and out again, a job for each 1,024 of them."""
    from helixframe.operators import kernel_rows

    monkeypatch.setattr(kernel_rows, "CHUNK", 10)
    monkeypatch.setattr(kernels, "MOST_ROWS", 16)
    monkeypatch.setattr(kernels, "BLOCK", 5)
    rows, k = _rbf(spark, 70, 3)
    rows._chosen = None  # no vector comes to the driver
    alpha = np.where(np.arange(70) % 3, np.linspace(0, 1, 70), 0.0)
    assert rows.combine(alpha) == pytest.approx(k @ alpha)
    assert rows.combine(1 - alpha) == pytest.approx(k @ (1 - alpha))


def test_baselines_take_the_pool_by_cells(spark, monkeypatch):
    r = np.random.default_rng(8)
    own = {s: np.round(r.exponential(9, 4 + s % 5), 1) for s in range(9)} | {9: np.array([5.0]), 10: np.round(r.normal(900, 1e-3, 6), 5)}
    label = {s: -1 if s % 3 == 2 else 1 for s in own}
    df = spark.createDataFrame([(s, label[s], float(v)) for s, x in own.items() for v in x], "subject int, label int, score double")
    laid, whole = [], density.gaussian_density
    monkeypatch.setattr(density, "gaussian_density", lambda points, grids, *rest: (laid.append({x.subject: x.size for x in grids.select("subject", "size").collect()}), whole(points, grids, *rest))[1])
    got = {}
    for x in density.baseline_curves(df, 40).collect():
        got.setdefault((x.subject, x.curve), []).append((x.grid_i, x.x, x.y))
    assert laid == [{s: len(x) for s, x in own.items()}]  # no subject's scores are cut up by the pool's size, and the pool meets no grid
    for s, x in own.items():
        rest = np.concatenate([v for o, v in own.items() if label[o] == 1 and o != s])
        grid = np.linspace(min(x.min(), rest.min()), max(x.max(), rest.max()), 40)
        for curve, v in (("own", x), ("baseline", rest)):
            h = (1e-6 if len(v) < 2 else v.std(ddof=1)) * len(v) ** -0.2
            i, at, y = zip(*sorted(got[s, curve]))
            assert i == tuple(range(40)) and at == pytest.approx(grid)
            assert y == pytest.approx(np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi)), abs=1e-9)
    monkeypatch.undo()
    assert density.baseline_curves(df.limit(0)).count() == 0
    v = np.round(r.exponential(30, 500), 2)
    for h in (1.3, 2.0, 80.0, 1e-3):
        width = 2.0 ** (np.floor(np.log2(h)) - 2)
        at = (v - v.min()) / width
        cells, inverse = np.unique(np.floor(at).astype(np.int64), return_inverse=True)
        moments = np.vstack([np.stack([np.bincount(inverse, (at - np.floor(at) - 0.5) ** k) for k in range(density.TERMS)], 1), np.zeros(density.TERMS)])
        x = np.linspace(-5, 300, 200)
        assert density._pool_bumps(cells, moments, width, v.min(), x, h) == pytest.approx(np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1), abs=1e-10)


def test_fold_overlay_pairs_whole_rounded_curves(spark, monkeypatch):
    rows = [(s, -1 if s > 4 else 1, (i * (s + 3)) % 17 + 0.123456789) for s in range(8) for i in range(10 + 3 * s)]
    df = spark.createDataFrame(rows, "subject int, label int, score double")
    key = lambda x: (x.fold, x.subject, x.grid_i)
    exact = {key(x): x for x in density.fold_overlay(df, 9).collect()}
    monkeypatch.setattr(statistics, "CHUNK", 4)
    near = {key(x): x for x in density.fold_overlay(df, 9, digits=3).collect()}
    assert exact.keys() == near.keys() and len(near) == 5 * 4 * 9
    for k, x in exact.items():
        assert (near[k].mean_score, near[k].x, near[k].y) == (pytest.approx(x.mean_score, abs=5.1e-4), pytest.approx(x.x, abs=5.1e-4), pytest.approx(x.y, abs=5.1e-4)) and round(near[k].y, 3) == near[k].y


def test_blocks_meet_without_a_copy_for_each_other_block(spark):
    r = np.random.default_rng(6)
    reads = spark.createDataFrame([(p, i, "".join(r.choice(list("ACGT"), 12))) for i in range(12) for p in "ab"], "patient string, read_idx long, seq string")
    scores = spark.createDataFrame([(s, 1 - 2 * (s % 2), float(v)) for s in range(6) for v in r.normal(s, 1, 9)], "subject int, label int, score double")
    for got in (kernels.distance_sums(features.read_vectors(reads, [2, 3], 1), {2: 0.4, 3: 0.6}), density.oa_all(scores), density.oa_all(scores, False)):
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan
    # what densities shuffle does not grow with the cells of subjects of one chunk
    assert "Generate explode" not in density.polynomials(scores)._jdf.queryExecution().toString()


def test_products_are_rounded_where_they_are_made(spark):
    r = np.random.default_rng(7)
    reads = spark.createDataFrame([("ab"[i % 2], i, "".join(r.choice(list("ACGTN" if i % 5 == 0 else "ACGT"), 9 + i % 4))) for i in range(40)], "patient string, read_idx long, seq string")
    f, w = features.read_vectors(reads, [2, 3], 1).cache(), {2: 0.4, 3: 0.6}
    exact = {(x.i, x.j): x.k for x in kernels.gram(f, w, cosine=True).collect()}
    near = {(x.i, x.j): x.k for x in kernels.gram(f, w, cosine=True, digits=3).collect()}
    assert near.keys() == exact.keys() and all(abs(near[p] - k) < 5.001e-4 and round(near[p], 3) == near[p] for p, k in exact.items())
    assert kernels.rounded(np.array([0.0078125, -0.0078125, 1.5, -0.0000001, 2.0]), 6).tolist() == [0.007813, -0.007813, 1.5, 0.0, 2.0]
    rows = kernels.vectors(f, w).toArrow()["vectors"]
    dense, product = kernels._Tile(rows, w, False), kernels.product(rows, rows, w)
    assert dense.dense is not None and (dense.times(dense) == product).all()
    plain = features.weighted_features(reads, 3, 0)
    counts = kernels.vectors(plain, {3: 1.0}).toArrow()["vectors"]  # letters beyond the alphabet: no matrix over the vocabulary
    other = kernels._Tile(counts, {3: 1.0}, False)
    assert other.dense is None and (other.times(other) == kernels.product(counts, counts, {3: 1.0})).all()


@pytest.mark.parametrize("places", [0, 1 << 16])
def test_reference_overlaps_are_added_up_where_pairs_are_made(spark, monkeypatch, places):
    monkeypatch.setattr(distances, "_PLACES", places)
    monkeypatch.setattr(kernels, "BLOCK", 5)
    monkeypatch.setattr(kernels, "MOST_ROWS", 11)
    r = np.random.default_rng(11)
    reads = spark.createDataFrame([("abcde"[i % 5], i, "".join(r.choice(list("ACGT"), 14))) for i in range(46)] + [("f", 100, "ACGTA"), ("e", 101, "AC")], "patient string, read_idx long, seq string")
    known = F.col("patient").isin("a", "b", "c")
    train, test = (features.weighted_features(reads.filter(x), 3, 0) for x in (known, ~known))
    one = {3: 1.0}
    want = pipelines.reference_scores(kernels.cross_gram(test, train, one, cosine=True), pipelines.reference_curve(kernels.gram(train, one, cosine=True), 60), 60)
    got = {x.patient: (x.oa, x.anomaly_score) for x in pipelines.reference_overlaps(train, test, one, 60).collect()}
    want = {x.patient: (x.oa, x.anomaly_score) for x in want.collect()}
    assert set(got) == {"d", "e", "f"} and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_folds_of_a_task_do_not_grow_with_patients(spark, monkeypatch):
    monkeypatch.setattr(cohorts, "TILE", 4)
    monkeypatch.setattr(cohorts, "SLICE", 5)
    df = spark.createDataFrame([(i, -1 if i % 3 == 0 else 1) for i in range(24)], "patient long, label int")
    folds = cohorts.loo_folds(df)
    got = folds.collect()
    assert len(got) == len({(x.fold, x.patient) for x in got}) == 16 * 24 and sum(x.role == "held_out" for x in got) == 16
    assert folds.rdd.getNumPartitions() == 4 * 5 and "Generate" not in folds._jdf.queryExecution().toString()
    assert cohorts.loo_folds(df.limit(0)).count() == 0
