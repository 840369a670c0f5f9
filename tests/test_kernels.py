"""Kernels, low-rank maps and the one-class model: algebra that must hold, and optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import features, kernels, nystrom, ocsvm
from helixframe.plans.pipelines import Kernel

from .test_sequences import SAMPLE, frame, plain

W = {2: 0.4, 3: 0.6}
SEQS = [*SAMPLE, "ATGMHC", "GGGCCCATA", "ATATATGC", "CCGATTAMH"]


def matrix(rows, n, m=None):
    out = np.full((n, m or n), np.nan)
    for r in rows:
        out[r.i.read_idx, r.j.read_idx] = r.k
        if m is None:
            out[r.j.read_idx, r.i.read_idx] = r.k
    return out


def both(spark, seqs=SEQS, m=1):
    return features.combined_features(frame(spark, seqs), 3, m, [0.0, 0.4, 0.6])


@pytest.mark.parametrize("block", [512, 3])
def test_gram_equals_feature_products(spark, block):
    want = sum(w * np.array([[sum(a[x] * b[x] for x in a) for b in v] for a in v]) for k, w in W.items() for v in [[plain(q, k, 1) for q in SEQS]])
    got = matrix(kernels.gram(both(spark), W, block).collect(), len(SEQS))
    assert np.allclose(got, want, atol=1e-10) and np.array_equal(got, got.T) and (np.diag(got) > 0).all()


def test_normalise_literal(spark):
    rows = spark.createDataFrame([(0, 0, 10.0), (0, 1, 2.0), (1, 1, 5.0)], "i long, j long, k double")
    d = spark.createDataFrame([(0, 10.0), (1, 5.0)], "id long, diag double")
    assert {(r.i, r.j): r.k for r in kernels.normalise(rows, d).collect()}[0, 1] == pytest.approx(2 / np.sqrt(50))


@pytest.mark.parametrize("m", [0, 1])
def test_asymmetric_is_a_slice_of_the_whole(spark, m):
    f = both(spark, m=m)
    whole = matrix(kernels.normalise(kernels.gram(f, W), kernels.diagonal(f, W)).collect(), len(SEQS))
    test, train = f.filter("read_idx < 3"), f.filter("read_idx >= 3")
    part = kernels.normalise(kernels.cross_gram(test, train, W, 2), kernels.diagonal(test, W), kernels.diagonal(train, W))
    got = matrix(part.collect(), len(SEQS), len(SEQS))
    assert np.allclose(got[:3, 3:], whole[:3, 3:], atol=1e-8)


def test_unit_rows_give_the_normalised_gram(spark):
    f = both(spark)
    norms = features.mkl_norms(f, [0.0, 0.4, 0.6])
    unit = f.join(norms, features.READ).withColumn("w", F.col("w") / F.col("norm")).drop("norm")
    a = matrix(kernels.gram(unit, W).collect(), len(SEQS))
    b = matrix(kernels.normalise(kernels.gram(f, W), kernels.diagonal(f, W)).collect(), len(SEQS))
    assert np.allclose(a, b, atol=1e-10) and np.allclose(np.diag(a), 1)


def test_nystrom(spark):
    reads, f = frame(spark, SEQS), both(spark)
    state = nystrom.fit(reads, f, W, 100)
    assert state.n_components == len(SEQS) - 1
    phi = nystrom.transform(f, state)
    assert len(phi.first().phi) == len(SEQS) - 1
    exact = kernels.normalise(kernels.gram(f, W), kernels.diagonal(f, W))
    e = nystrom.intrinsic_errors(exact, phi).first()
    assert e.rel_frobenius_error < 0.3 and e.max_diag_error < 0.8
    p = {r.read_idx: np.array(r.phi) for r in phi.collect()}
    on = [i for _, i in state.order]
    whole = matrix(exact.collect(), len(SEQS))
    assert all(abs(p[i] @ p[j] - whole[i, j]) < 1e-8 for i in on for j in on)
    with pytest.raises(ValueError):
        nystrom.fit(frame(spark, ["ATG"]), f, W, 5)


def test_truncation():
    x = np.ones((3, 2))
    root, kept = nystrom.inverse_root(x @ x.T)
    assert kept == 1 and np.isfinite(root).all()


@pytest.mark.parametrize("nu", [0.05, 0.2, 0.5])
def test_one_class_optimality(nu):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 4))
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    m = ocsvm.solve(k, nu, tol=1e-6)
    g = k @ m.alpha
    assert m.alpha.sum() == pytest.approx(nu * 200) and m.alpha.min() >= 0 and m.alpha.max() <= 1
    assert g[m.alpha < 1].min() >= g[m.alpha > 0].max() - 1e-5
    assert (m.alpha > 0).mean() >= nu - 1e-9 and (g - m.rho < -1e-5).mean() <= nu + 1e-9
    with pytest.raises(ValueError):
        ocsvm.solve(k, 0)


def test_primal_agrees_with_exact(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(150, 5)) + 2
    x /= np.linalg.norm(x, axis=1)[:, None]
    phi = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "read_idx long, phi array<double>")
    w, _ = ocsvm.fit_primal(phi, 0.2, 60)
    a = ocsvm.solve(x @ x.T, 0.2, 1e-6).alpha @ x
    assert w @ w <= 1.01 * (a @ a) and np.corrcoef(x @ w, x @ a)[0, 1] > 0.99


def _slow_maps(spark):
    r = np.random.default_rng(6)
    x = np.abs(r.normal(size=(120, 6))) + 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x, spark.createDataFrame([(v.tolist(),) for v in x], "phi array<double>")


def test_primal_meets_its_tolerance_or_says_so(spark, monkeypatch):
    x, phi = _slow_maps(spark)
    w, rho = ocsvm.fit_primal(phi, 0.2)
    s = np.sort(x @ w)
    assert w @ w - s[:24].sum() <= 1.1e-6 * max(1, w @ w) and s[23] - 1e-9 <= rho <= s[24] + 1e-9
    with pytest.warns(UserWarning, match="after 3 passes"):
        ocsvm.fit_primal(phi, 0.2, 3)
    monkeypatch.setattr(ocsvm, "MAX_PASSES", 3)
    with pytest.raises(RuntimeError, match="after 3 passes"):
        ocsvm.fit_primal(phi, 0.2)


def test_low_rank_query_runs_to_the_tolerance(spark, monkeypatch):
    """The registered query leaves the number of passes to the solver."""
    from helixframe.plans import catalogue

    asked = []
    monkeypatch.setattr(ocsvm, "fit_primal", lambda phi, nu, passes=None: asked.append(passes) or (np.ones(len(phi.first().phi)), 0.0))
    catalogue.QUERIES["ocsvm_scores_nystrom"](spark, "/root/testdata/sf0.001")
    assert asked == [None]


def test_scores_and_predictions(spark):
    from helixframe.plans import pipelines

    r = np.random.default_rng(3)
    seqs = ["".join(r.choice(list("ACGT"), 30)) for _ in range(30)] + ["".join(r.choice(list("MH"), 30)) for _ in range(5)]
    reads = frame(spark, seqs)
    train, test = reads.filter("read_idx < 25"), reads.filter("read_idx >= 25")
    rows = pipelines.exact_scores(train, test, Kernel(3, 1, (0.0, 0.4, 0.6)), 0.2).collect()
    by = {x.read_idx: x for x in rows}
    assert {x.predicted for x in rows} <= {-1, 1} and max(by[i].decision for i in range(30, 35)) < min(by[i].decision for i in range(25, 30))
    low = {x.read_idx: x.decision for x in pipelines.low_rank_scores(train, test, Kernel(3, 1, (0.0, 0.4, 0.6)), 15, 0.2, passes=30).collect()}
    assert np.corrcoef([by[i].decision for i in range(25, 35)], [low[i] for i in range(25, 35)])[0, 1] > 0.4


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1.0, 0.0])], "h array<array<double>>, m array<double>")
    assert df.select(kernels.masked_mean(F.col("h"), F.col("m")).alias("x")).first().x == [1.0, 2.0]


def test_stored_model_scores_alike(spark, tmp_path):
    from helixframe.plans import pipelines
    from helixframe.sources import model_store

    kernel = Kernel(3, 1, (0.0, 0.4, 0.6))
    reads, test = frame(spark, SEQS), frame(spark, ["ATGCAT", "HHMMHH", "AC"])
    params, tables = pipelines.train(reads, kernel, 0.5)
    model_store.save_model(spark, str(tmp_path / "m"), params, tables)
    got = {r.read_idx: r.score for r in pipelines.infer(test, *model_store.load_model(spark, str(tmp_path / "m"), "precomputed")).collect()}
    want = {r.read_idx: -r.decision for r in pipelines.exact_scores(reads, test, kernel, 0.5).collect()}
    assert got == pytest.approx(want)


def test_embedding_scores_and_submatrix(spark):
    from helixframe.plans import pipelines

    r = np.random.default_rng(5)
    x = np.vstack([r.normal(size=(40, 6)), r.normal(size=(5, 6)) + 8])
    e = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<float>")
    out = {r.id: r.decision for r in pipelines.embedding_scores(e.filter("id < 35"), e.filter("id >= 35"), "rbf").collect()}
    assert max(out[i] for i in range(40, 45)) < min(out[i] for i in range(35, 40))
    k = kernels.embedding_kernel(e, e)
    ids = spark.createDataFrame([(0,), (3,)], "id long")
    assert {(r.i, r.j): r.k for r in kernels.submatrix(k, ids).collect()} == pytest.approx({(i, j): float(np.float32(x[i]).astype(float) @ np.float32(x[j]).astype(float)) for i in (0, 3) for j in (0, 3)})
