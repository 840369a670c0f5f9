"""The exact one-class solver by working sets: against a dense one, with small caches, along nu; and the distributed low-rank fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import features, kernels, ocsvm
from helixframe.operators.kernel_rows import EmbeddingRows, StringRows
from helixframe.plans import pipelines

from .test_sequences import frame


def _rbf(spark, n, parts=5):
    x = np.random.default_rng(1).normal(size=(n, 12))
    gamma = 1 / (12 * x.var())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(parts)
    rows = EmbeddingRows(df, "rbf", gamma)
    t = rows.stored.select("row", "id").toArrow()
    order = np.empty(n, np.int64)
    order[rows.places(np.asarray(t["row"]))] = np.asarray(t["id"])
    x = x[order]
    return rows, np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))


def test_large_set_with_a_cache_of_500_rows(spark):
    rows, k = _rbf(spark, 3000, 8)
    want = ocsvm.solve(k, 0.2, 1e-6)
    got = ocsvm.solve_rows(rows, 0.2, 1e-6, cache_rows=500)
    assert np.abs(got.alpha - want.alpha).max() < 1e-3 and got.rho == pytest.approx(want.rho, abs=1e-3)
    assert rows.computed < 3000  # far from a whole kernel


@pytest.mark.parametrize("working,cache", [(2, 2), (8, 8), (40, 12)])
def test_small_working_sets_and_caches(spark, working, cache):
    rows, k = _rbf(spark, 60)
    want = ocsvm.solve(k, 0.3, 1e-4)
    got = ocsvm.solve_rows(rows, 0.3, 1e-4, working=working, cache_rows=cache)
    assert got.alpha.sum() == pytest.approx(18) and got.rho == pytest.approx(want.rho, abs=1e-3)
    g = k @ got.alpha
    assert g[got.alpha > 0].max() - g[got.alpha < 1].min() < 2e-4


def test_rows_places_and_sums(spark):
    rows, k = _rbf(spark, 41)
    which, active = np.array([7, 3, 40]), np.array([0, 3, 5, 39])
    assert np.allclose(rows.rows(which, active), k[np.ix_(which, active)]) and np.allclose(rows.rows(which, np.arange(41)), k[which])
    alpha = np.where(np.arange(41) % 3 == 0, 0.5, 0.0)
    assert np.allclose(rows.combine(alpha), k @ alpha) and np.allclose(rows.diagonal(), 1)
    assert {r.alpha for r in rows.with_alpha(alpha).collect()} == {0.5} and rows.with_alpha(alpha).count() == 14


def test_string_rows_are_the_normalised_gram(spark):
    seqs = ["ATGCAA", "GGCATT", "", "A", "MHMHMHATG", "ACGTACGT", "NNACGNAC"]
    reads = frame(spark, seqs)
    w = {2: 0.4, 3: 0.6}
    f = features.combined_features(reads, 3, 1, [0.0, 0.4, 0.6])
    rows = StringRows(reads, f, w)
    g = {(r.i.read_idx, r.j.read_idx): r.k for r in kernels.normalise(kernels.gram(f, w), kernels.diagonal(f, w)).collect()}
    t = rows.stored.select("row", "id").collect()
    idx = dict(zip(rows.places(np.array([r.row for r in t])).tolist(), [r.id.read_idx for r in t]))
    k = rows.rows(np.arange(7), np.arange(7))
    for a in range(7):
        for b in range(7):
            i, j = sorted((idx[a], idx[b]))
            assert k[a, b] == pytest.approx(g.get((i, j), 0.0), abs=1e-9)
    alpha = np.random.default_rng(3).random(7)
    assert np.allclose(rows.combine(alpha), k @ alpha)


def test_path_over_nu_equals_separate_models(spark):
    rows, k = _rbf(spark, 200)
    for nu, model in ocsvm.solve_path(rows, [0.5, 0.1, 0.2], 1e-6).items():
        want = ocsvm.solve(k, nu, 1e-6)
        assert model.alpha.sum() == pytest.approx(200 * nu) and np.abs(model.alpha - want.alpha).max() < 1e-3 and model.rho == pytest.approx(want.rho, abs=1e-4)
    for total in (0.5, 3.0, 4.0):
        a = ocsvm.repaired(np.array([1.0, 0.2, 0.0, 0.0]), total)
        assert a.sum() == pytest.approx(total) and a.min() >= 0 and a.max() <= 1
    assert ocsvm.repaired(np.zeros(4), 2.0).tolist() == [0.5] * 4


def test_models_of_several_nu(spark):
    r = np.random.default_rng(3)
    seqs = ["".join(r.choice(list("ACGT"), 30)) for _ in range(24)] + ["".join(r.choice(list("MH"), 30)) for _ in range(6)]
    rows = [(f"p{i // 6}", i, -1 if i >= 24 else 1, s) for i, s in enumerate(seqs)]
    reads = spark.createDataFrame(rows, "patient string, read_idx long, label int, seq string")
    train, test, kernel = reads.filter("patient < 'p2'"), reads.filter("patient >= 'p2'"), pipelines.Kernel(2, 1, (0.0, 1.0))
    units = pipelines.nu_comparison(train, test, kernel, [0.1, 0.4], 3).collect()
    assert {(u.nu, u.subject) for u in units} == {(nu, p) for nu in (0.1, 0.4) for p in ("p2", "p3")} and all(0 <= u.auc <= 1 for u in units)
    for nu, (vector, rho) in pipelines.nu_models(train, kernel, [0.4, 0.1]).items():
        got = {x.id.read_idx: x.decision for x in ocsvm.decide_primal(kernel.features(test), vector, kernel.by_k, rho, test).collect()}
        alone = {x.read_idx: x.decision for x in pipelines.exact_scores(train, test, kernel, nu).collect()}
        assert got == pytest.approx(alone, abs=5e-3)


def test_no_reads_and_one_read(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert ocsvm.solve_rows(EmbeddingRows(empty), 0.2).alpha.tolist() == []
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    m = ocsvm.solve_rows(EmbeddingRows(one), 0.5)
    assert m.alpha.tolist() == [0.5] and m.rho == pytest.approx(2.5)
    with pytest.raises(ValueError):
        ocsvm.solve_rows(EmbeddingRows(one), 0.0)


def test_low_rank_fit_on_many_partitions(spark):
    """The distributed passes against a dense solver of the same problem."""
    r = np.random.default_rng(2)
    x = np.abs(r.normal(size=(300, 8))) + 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    phi = spark.createDataFrame([(v.tolist(),) for v in x], "phi array<double>")
    one, _ = ocsvm.fit_primal(phi.coalesce(1), 0.2)
    w, rho = ocsvm.fit_primal(phi.repartition(8), 0.2)
    assert np.allclose(w, one, rtol=1e-6, atol=1e-6)
    a = ocsvm.solve(x @ x.T, 0.2, 1e-7)
    assert np.linalg.norm(w - a.alpha @ x) < 2e-3 * np.linalg.norm(w) and rho == pytest.approx(a.rho, rel=1e-3)
    assert not hasattr(ocsvm, "HELD")


def test_own_analyzer(spark):
    reads = frame(spark, ["ATGCAA", "GGCATT", "ATATGC", None, "AC"])
    own = features.analyzed(reads, lambda s: [s[i : i + 3] for i in range(len(s) - 2)], 3)
    exact = {(r.read_idx, r.kmer): float(r.cnt) for r in features.kmer_counts(reads, 3).collect()}
    assert {(r.read_idx, r.kmer): r.w for r in own.collect()} == exact
    kernel = pipelines.Kernel(analyzer=lambda s: [f"{s[i]}-{s[i + 2]}" for i in range(len(s) - 2)])
    f = kernel.features(reads)
    g = {(r.i.read_idx, r.j.read_idx): r.k for r in kernels.gram(f, kernel.by_k).collect()}
    tokens = [[f"{s[i]}-{s[i + 2]}" for i in range(len(s or "") - 2)] for s in ["ATGCAA", "GGCATT", "ATATGC"]]
    assert g == {(i, j): sum(a == b for a in tokens[i] for b in tokens[j]) for i in range(3) for j in range(i, 3)}
    scored = pipelines.exact_scores(reads.filter("read_idx < 2"), reads, kernel, 0.5)
    assert scored.count() == 5


@pytest.mark.parametrize("k,m", [(1, 1), (3, 1), (3, 2), (2, 2)])
def test_features_without_a_shuffle_equal_the_plain_ones(spark, k, m):
    from .test_sequences import plain

    seqs = ["ATGCAA", "", "NAN", "ATNNGC", "acgtmh", "A", "AAAAAAAAAA", "NNNN"]
    got = {}
    for r in features.weighted_features(frame(spark, seqs), k, m).collect():
        got.setdefault(r.read_idx, {})[r.kmer] = r.w
    assert got == {i: p for i, s in enumerate(seqs) if (p := plain(s.upper(), k, m))}
    assert features.weighted_features(frame(spark, seqs).withColumn("seq", F.lit(None).cast("string")), k, m).count() == 0


def test_missing_k_counts_as_zero(spark):
    reads = frame(spark, ["ATGCAA", "AC"])
    f = features.combined_features(reads, 3, 0, [0.0, 0.4, 0.6])
    g = {(r.i.read_idx, r.j.read_idx): r.k for r in kernels.gram(f, {2: 0.4, 3: 0.6}).collect()}
    two = {(r.i.read_idx, r.j.read_idx): r.k for r in kernels.gram(f.filter("k = 2"), {2: 0.4}).collect()}
    assert g[0, 1] == two[0, 1] and g[1, 1] == two[1, 1]  # the short read has no string of three letters


def test_vectors_from_reads_equal_packed_features(spark):
    from helixframe.operators import nystrom

    reads = frame(spark, ["ATGCAA", "GGCATT", "", "NNN", "MHMHMHATG", "ACGNACGT", None])
    w, kernel = {2: 0.4, 3: 0.6}, pipelines.Kernel(3, 1, (0.0, 0.4, 0.6))
    long, short = kernel.features(reads), kernel.rows(reads)
    as_dict = lambda df: {r.id.read_idx: sorted((v.k, tuple(v.cols), tuple(v.ws)) for v in r.vectors) for r in df.collect()}
    assert as_dict(kernels.vectors(long, w)) == as_dict(kernels.vectors(short, w))
    assert {r.id.read_idx: r["diag"] for r in kernels.diagonal(long, w).collect()} == pytest.approx({r.id.read_idx: r["diag"] for r in kernels.diagonal(short, w).collect()})
    assert sorted(nystrom.vocabulary(long).collect()) == sorted(nystrom.vocabulary(short).collect())
    own = reads.filter("read_idx IN (0, 4, 5)")
    a, b = (nystrom.fit(own, f, w, 2) for f in (long, short))
    assert a.order == b.order and np.allclose(a.inverse_root, b.inverse_root)
    some = nystrom.vocabulary(long.filter("read_idx IN (0, 4)"))
    phi = [{r.read_idx: r.phi for r in nystrom.transform(f, a, some, reads).collect()} for f in (long, short)]
    assert set(phi[0]) == set(phi[1]) == set(range(7)) and all(phi[0][i] == pytest.approx(phi[1][i]) for i in phi[0])
    ids = own.select(F.struct("patient", "read_idx").alias("id"), F.lit(0.5).alias("alpha"))
    v = [ocsvm.primal(f.join(own.select("patient", "read_idx"), features.READ, "left_semi"), ids, w) for f in (long, short)]
    assert {(r.k, r.kmer): r.v for r in v[0].collect()} == pytest.approx({(r.k, r.kmer): r.v for r in v[1].collect()})
    got = [{r.id.read_idx: r.decision for r in ocsvm.decide_primal(f, v[0], w, 0.25, reads).collect()} for f in (long, short)]
    assert got[0] == pytest.approx(got[1]) and got[1][2] == -0.25
    with pytest.raises(ValueError):
        features.read_vectors(reads, [3], 0)


def test_rows_that_fit_the_cache_are_fetched_once(spark):
    rows, k = _rbf(spark, 600)
    calls, own = [], rows.rows
    rows.rows = lambda which, active: calls.append(len(which)) or own(which, active)
    got, want = ocsvm.solve_rows(rows, 0.3, 1e-5), ocsvm.solve(k, 0.3, 1e-6)
    assert calls == [600] and np.abs(got.alpha - want.alpha).max() < 1e-3 and got.rho == pytest.approx(want.rho, abs=1e-3)
