"""One-class SVM: minimise a'Ka / 2 with 0 <= a <= 1 and sum a = nu * n, the scaling under which scores are published.

The exact solver takes small working sets of the most violating reads. Their kernel rows come from the executors and stay in a bounded
cache; the driver holds a few numbers a read, never a kernel. On low-rank maps the primal runs distributed: each pass
sums (sub)gradients over partitions, so reads never meet on the driver.
"""

from __future__ import annotations

import warnings
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import ALPHABET
from ..functions.statistics import value_at_rank
from .kernel_rows import CHUNK, KernelRows

#: The driver's arrays of one number a read, and all rows of its cache.
MAX_EXACT, CACHE_BYTES = 10_000_000, 256 << 20
MAX_PASSES = 1000
#: Reads above which no kernel rows come to the driver, and reads of a round there.
MANY, WORKING = 8192, 2048


@dataclass
class OneClass:
    alpha: np.ndarray
    rho: float


def _first_alpha(n: int, nu: float) -> np.ndarray:
    if not 0 < nu <= 1:
        raise ValueError("nu lies in (0, 1]")
    alpha = np.zeros(n)
    full = int(nu * n)
    alpha[:full] = 1
    if full < n:
        alpha[full] = nu * n - full
    return alpha


def _optimise(kernel: np.ndarray, alpha: np.ndarray, grad: np.ndarray, tol: float, max_steps: int) -> None:
    """Sequential minimal optimisation in place: the two most violating coordinates at a time, by second-order gain."""
    diag = np.diag(kernel)
    for _ in range(max_steps):
        up, down = alpha < 1, alpha > 0
        if not up.any() or not down.any():
            return
        i = int(np.argmin(np.where(up, grad, np.inf)))
        gap = np.where(down, grad - grad[i], -np.inf)
        if gap.max() < tol:
            return
        curve = np.maximum(diag[i] + diag - 2 * kernel[i], 1e-12)
        j = int(np.argmax(np.where(gap > 0, gap * gap / curve, -np.inf)))
        step = min(gap[j] / curve[j], 1 - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        if alpha[i] > 1 - 1e-12:
            alpha[i] = 1.0
        if alpha[j] < 1e-12:
            alpha[j] = 0.0
        grad += step * (kernel[i] - kernel[j])


def _rho(alpha: np.ndarray, grad: np.ndarray) -> float:
    free = (alpha > 0) & (alpha < 1)
    if free.any():
        return float(grad[free].mean())
    lower = grad[alpha >= 1].max() if (alpha >= 1).any() else -np.inf
    upper = grad[alpha <= 0].min() if (alpha <= 0).any() else np.inf
    return float((lower + upper) / 2) if np.isfinite(lower + upper) else float(lower if np.isfinite(lower) else upper)


def solve(kernel: np.ndarray, nu: float, tol: float = 1e-3, max_steps: int | None = None) -> OneClass:
    """The model of a small precomputed kernel."""
    n = len(kernel)
    alpha = _first_alpha(n, nu)
    grad = kernel @ alpha
    _optimise(kernel, alpha, grad, tol, max_steps or max(10_000_000, 100 * n))
    return OneClass(alpha, _rho(alpha, grad))


class _Cache:
    """Kernel rows over the active places, the latest used; all are cut when places leave."""

    def __init__(self, rows: KernelRows, most: int):
        self.rows, self.most, self.kept, self.active = rows, most, OrderedDict(), np.arange(rows.n)

    def get(self, which: np.ndarray) -> np.ndarray:
        missing = np.array([w for w in which.tolist() if w not in self.kept], np.int64)
        if len(missing):
            self.kept.update(zip(missing.tolist(), self.rows.rows(missing, self.active)))
        out = np.array([self.kept[w] for w in which.tolist()])
        for w in which.tolist():
            self.kept.move_to_end(w)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return out

    def shrink(self, keep: np.ndarray) -> None:
        """Go on with the flagged ones of the active places."""
        self.active = self.active[keep]
        self.kept = OrderedDict((w, row[keep]) for w, row in self.kept.items())

    def reset(self) -> None:
        self.active, self.kept = np.arange(self.rows.n), OrderedDict()


def solve_rows(rows: KernelRows, nu: float, tol: float = 1e-3, *, working: int = 256, cache_rows: int | None = None, start: np.ndarray | None = None, max_rounds: int = 10_000) -> OneClass:
    """The model of any number of reads, by working sets.

    Each round takes the reads that violate optimality most, at most `working`, solves for them alone and moves the gradient along
    their kernel rows. Reads at a bound that no violating pair can use leave the active places; once those that are left are
    optimal, the whole gradient is made anew and all reads are looked at again. `cache_rows` (by default what CACHE_BYTES hold) are kept.
    Above MANY reads no kernel rows are kept (`_solve_many`, which finds a start and a working set of its own), unless `cache_rows` asks for it.
    """
    n = rows.n
    if n > MAX_EXACT:
        raise ValueError(f"the exact solver holds arrays over all reads on the driver: at most {MAX_EXACT}; use fit_primal")
    if n > MANY and cache_rows is None:
        return _solve_many(rows, nu, tol, max_rounds)
    most = max(working, CACHE_BYTES // (8 * max(n, 1))) if cache_rows is None else cache_rows
    alpha = _first_alpha(n, nu) if start is None else start.copy()
    if not n:
        return OneClass(alpha, 0.0)
    grad, cache, working = rows.combine(alpha), _Cache(rows, most), max(2, min(working, most, n))
    whole = cache_rows is None and n <= most  # all rows fit: each is fetched once, and no place leaves, as the rest would be fetched again
    for i in range(0, n if whole else 0, CHUNK):
        cache.get(np.arange(i, min(n, i + CHUNK)))
    for round_ in range(max_rounds):
        active = cache.active
        a, g = alpha[active], grad[active]
        up, down = a < 1, a > 0
        low, high = (g[up].min() if up.any() else np.inf), (g[down].max() if down.any() else -np.inf)
        if high - low < tol:
            if len(active) == n:
                return OneClass(alpha, _rho(alpha, grad))
            grad = rows.combine(alpha)
            cache.reset()
            continue
        ups, downs = np.flatnonzero(up), np.flatnonzero(down)
        half = working // 2
        ups = ups[np.argsort(g[ups], kind="stable")[: working - half]]
        downs = downs[np.argsort(-g[downs], kind="stable")[:half]]
        at = np.unique(np.concatenate([ups[g[ups] < high], downs[g[downs] > low]]))
        which = active[at]
        k = cache.get(which)
        a, g, before = a[at].copy(), g[at].copy(), a[at].copy()
        _optimise(k[:, at], a, g, tol / 2, 200 * len(at))
        alpha[which] = a
        grad[active] += (a - before) @ k
        if round_ % 4 == 3 and not whole:
            a, g = alpha[active], grad[active]
            low, high = g[a < 1].min(initial=np.inf), g[a > 0].max(initial=-np.inf)
            idle = ((a <= 0) & (g > high)) | ((a >= 1) & (g < low))
            if 10 * idle.sum() > len(active):
                cache.shrink(~idle)
    raise RuntimeError(f"the optimality gap does not meet its tolerance after {max_rounds} rounds")


def _lowest(grad: np.ndarray, nu: float) -> np.ndarray:
    """The weights that a fixed gradient asks for: 1 at its least values."""
    alpha = np.zeros(len(grad))
    alpha[np.argsort(grad, kind="stable")] = _first_alpha(len(grad), nu)
    return alpha


def _solve_many(rows: KernelRows, nu: float, tol: float, max_rounds: int, working: int = WORKING) -> OneClass:
    """`solve_rows` of very many reads, without kernel rows on the driver: a round takes the kernel among its working set, and the
    executors move the gradient by what its weights changed, a number a read. It begins where a model of evenly spaced reads says."""
    n = rows.n
    sample = np.unique(np.linspace(0, n - 1, working).astype(np.int64))
    x = rows.vectors_at(sample)
    spread = np.zeros(n)
    spread[sample] = solve(rows.product(x, x), nu, 1e-3).alpha
    alpha = _lowest(rows.combine(spread), nu)
    grad, fresh = rows.combine(alpha), True
    for _ in range(max_rounds):
        up, down = alpha < 1, alpha > 0
        low, high = grad[up].min(initial=np.inf), grad[down].max(initial=-np.inf)
        if high - low < tol:
            if fresh:
                return OneClass(alpha, _rho(alpha, grad))
            grad, fresh = rows.combine(alpha), True
            continue
        free = np.flatnonzero(up & down)
        free = free[np.argsort(np.abs(grad[free] - (low + high) / 2), kind="stable")[: working // 2]]
        half = (working - len(free)) // 2
        ups, downs = np.flatnonzero(up & (grad < high)), np.flatnonzero(down & (grad > low))
        ups = ups[np.argpartition(grad[ups], half)[:half]] if len(ups) > half else ups
        downs = downs[np.argpartition(-grad[downs], half)[:half]] if len(downs) > half else downs
        which = np.unique(np.concatenate([free, ups, downs]))
        x = rows.vectors_at(which)
        a, g = alpha[which], grad[which]
        _optimise(rows.product(x, x), a, g, tol / 2, 100 * len(which))
        moved = np.zeros(n)
        moved[which] = a - alpha[which]
        alpha[which] = a
        grad, fresh = grad + rows.combine(moved), False
    raise RuntimeError(f"the optimality gap does not meet its tolerance after {max_rounds} rounds")


def repaired(alpha: np.ndarray, total: float) -> np.ndarray:
    """Weights near alpha, from 0 to 1, whose sum is `total`: scaled, cut at 1, and what is missing spread over the room that is left."""
    own = alpha.sum()
    out = np.minimum(alpha * (total / own), 1.0) if own > 0 else np.zeros_like(alpha)
    missing, room = total - out.sum(), (1 - out).sum()
    return out if missing <= 0 or room <= 0 else np.minimum(out + (1 - out) * (missing / room), 1.0)


def solve_path(rows: KernelRows, nus: list[float], tol: float = 1e-3, **options) -> dict[float, OneClass]:
    """A model for each nu, in ascending order, each begun at the weights of the one before (at a sample's model, above MANY reads)."""
    out: dict[float, OneClass] = {}
    for nu in sorted(set(nus)):
        start = repaired(out[max(out)].alpha, nu * rows.n) if out else None
        out[nu] = solve_rows(rows, nu, tol, start=start, **options)
    return out


def fit_rows(rows: KernelRows, nu: float, tol: float = 1e-3, **options) -> tuple[DataFrame, float]:
    """((id, alpha) of the support vectors, rho)."""
    model = solve_rows(rows, nu, tol, **options)
    return rows.with_alpha(model.alpha), model.rho


def decide(cross: DataFrame, alpha: DataFrame, rho: float) -> DataFrame:
    """(id, decision): sum of alpha * k over the support vectors, less rho."""
    return cross.join(F.broadcast(alpha.select(F.col("id").alias("j"), "alpha")), "j").groupBy(F.col("i").alias("id")).agg((F.sum(F.col("alpha") * F.col("k")) - rho).alias("decision"))


def primal(support: DataFrame, alpha: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(k, kmer, v): the model as one vector over strings, sum of alpha * unit features * kernel weight.

    A normalised string kernel is linear in unit features, so scoring needs no kernel: at most the vocabulary, 6 ** k rows a k.
    """
    from . import kernels

    if "vectors" in support.columns:
        return _primal_of_vectors(support, alpha, weights)
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("k"))
    norms = kernels.diagonal(support, weights).join(alpha, "id").select("id.*", (F.col("alpha") / F.sqrt(F.greatest("diag", F.lit(1e-12)))).alias("a"))
    rows = support.filter(F.col("k").isin(list(weights))).join(norms, ["patient", "read_idx"])
    return rows.groupBy("k", "kmer").agg((F.sum(F.col("a") * F.col("w")) * F.first(w)).alias("v"))


def decide_primal(features: DataFrame, vector: DataFrame, weights: dict[int, float], rho: float, reads: DataFrame | None = None) -> DataFrame:
    """(id, decision) of reads' features (strings unknown to the model count in the norm): one pass and one small join.

    With `reads`, those without any feature (empty or too short) get -rho, as a kernel value of 0 with every read has it.
    """
    from . import kernels

    if "vectors" in features.columns:
        return _decide_vectors(features, vector, weights, rho, reads)
    hits = features.join(F.broadcast(vector), ["k", "kmer"]).groupBy("patient", "read_idx").agg(F.sum(F.col("w") * F.col("v")).alias("dot")).select(F.struct("patient", "read_idx").alias("id"), "dot")
    d = kernels.diagonal(features, weights).join(hits, "id", "left")
    if reads is not None:
        d = reads.select(F.struct("patient", "read_idx").alias("id")).distinct().join(d, "id", "left")
    return d.select("id", (F.coalesce("dot", F.lit(0.0)) / F.sqrt(F.greatest(F.coalesce("diag", F.lit(0.0)), F.lit(1e-12))) - rho).alias("decision"))


def _primal_of_vectors(support: DataFrame, alpha: DataFrame, weights: dict[int, float]) -> DataFrame:
    """The same from `features.read_vectors`: each task adds up its support vectors, and sums meet by string."""
    from . import kernels
    from .features import strings_of

    def add(batches):
        sums = {k: np.zeros(len(ALPHABET) ** k) for k in weights}
        for b in batches:
            for at in range(0, b.num_rows, kernels.BLOCK):
                x, a = pa.chunked_array([b.column(0).slice(at, kernels.BLOCK)]), np.asarray(b.column(1).slice(at, kernels.BLOCK))
                _, own, k, col, value = kernels._flat(x)
                value = value * (a / kernels.norms(x, weights))[own]
                for kk, total in sums.items():
                    total += np.bincount(col[k == kk], value[k == kk], len(total))
        for k, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), strings_of(k).take(pa.array(some)), pa.array(total[some] * weights[k])], ["k", "kmer", "v"])

    rows = kernels.vectors(support, weights).join(alpha, "id").select("vectors", "alpha")
    return rows.mapInArrow(add, "k int, kmer string, v double").groupBy("k", "kmer").agg(F.sum("v").alias("v"))


def dot_of(vector: DataFrame, weights: dict[int, float]) -> Callable[[str], Column]:
    """A column function: a read's unit vector (of `features.read_vectors`) times the model (k, kmer, v).

    The model is at most the vocabulary of each k; it goes to every executor once, as dense arrays.
    """
    from . import kernels

    letters, model = {a: i for i, a in enumerate(ALPHABET)}, {k: np.zeros(len(ALPHABET) ** k) for k in weights}
    t = vector.filter(F.col("k").isin(list(weights))).toArrow()
    for k, kmer, v in zip(t["k"].to_pylist(), t["kmer"].to_pylist(), t["v"].to_pylist()):
        model[k][sum(letters[a] * len(ALPHABET) ** p for p, a in enumerate(reversed(kmer)))] = v
    shared = vector.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def dot(rows: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(rows), kernels.BLOCK):
            x = pa.chunked_array([rows.slice(at, kernels.BLOCK)])
            n, own, k, col, value = kernels._flat(x)
            total = np.zeros(n)
            for kk, v in shared.value.items():
                mine = k == kk
                total += np.bincount(own[mine], value[mine] * v[col[mine]], n)
            out.append(total / kernels.norms(x, weights))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return dot


def _decide_vectors(features: DataFrame, vector: DataFrame, weights: dict[int, float], rho: float, reads: DataFrame | None) -> DataFrame:
    """The same of `features.read_vectors`."""
    from . import kernels

    d = kernels.vectors(features, weights).select("id", dot_of(vector, weights)("vectors").alias("dot"))
    if reads is not None:
        d = reads.select(F.struct("patient", "read_idx").alias("id")).distinct().join(d, "id", "left")
    return d.select("id", (F.coalesce("dot", F.lit(0.0)) - rho).alias("decision"))


def predict(decision: Column) -> Column:
    """1 where the decision is above 0, else -1."""
    return F.when(decision > 0, 1).otherwise(-1)


def _dot(phi: Column, w: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def dot(rows: pa.Array) -> pa.Array:
        return pa.array(_matrix(rows, len(w)) @ w)

    return dot(phi)


def _matrix(rows: pa.Array, d: int) -> np.ndarray:
    return np.asarray(rows.flatten()).reshape(-1, d)


def _nearest_to_zero(atoms: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(atoms that count, their shares) of the shortest vector in the hull of some atoms, from a point of it (the minimum-norm point method).

    Least squares over differences of atoms: products of atoms would square their condition, and sums over many reads lie close together,
    so that a new atom would be taken for one that does not help.
    """
    while True:
        n, base = len(atoms), int(np.argmax(share))
        rest = np.delete(np.arange(n), base)
        best = np.empty(n)
        best[rest] = np.linalg.lstsq((atoms[rest] - atoms[base]).T, -atoms[base], rcond=1e-13)[0]
        best[base] = 1 - best[rest].sum()
        if best.min() >= -1e-12 or n == 1:
            return atoms, np.maximum(best, 0) / np.maximum(best, 0).sum()
        down = best < 0
        step = float(np.min(share[down] / np.maximum(share[down] - best[down], 1e-300)))
        share = (1 - step) * share + step * best
        keep = share > 1e-12
        if keep.all():
            keep[int(np.argmin(np.where(down, share, np.inf)))] = False
        atoms, share = atoms[keep], share[keep] / share[keep].sum()


def fit_primal(phi: DataFrame, nu: float, passes: int | None = None) -> tuple[np.ndarray, float]:
    """(w, rho) on maps (phi): the dual's sum is nu * n, so w = sum of alpha * phi.

    Frank-Wolfe on the dual, fully corrective: each pass sends w to the partitions, finds the score of rank nu * n
    (`statistics.value_at_rank`), and returns the sum of the vectors below it; w is then the shortest vector in the hull of those
    sums. It ends when the duality gap meets its tolerance, and raises if that takes more than MAX_PASSES; where the caller bounds `passes`, it warns instead.
    """
    phi = phi.select("phi").cache()
    n, d = phi.count(), len(phi.first().phi)
    budget = nu * n

    def summed(weight) -> np.ndarray:
        def work(batches):
            total = np.zeros(d)
            for b in batches:
                x = _matrix(b.column(0), d)
                total += weight(x) @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total)], ["p", "x"])

        out = np.zeros(d)
        for r in phi.mapInArrow(work, "p bigint, x double").groupBy("p").agg(F.sum("x").alias("x")).collect():
            out[r.p] = r.x
        return out

    w = summed(lambda x: np.full(len(x), nu))
    rho, met, atoms, share_of = 0.0, False, w[None, :], np.ones(1)
    for _ in range(MAX_PASSES if passes is None else passes):
        rank = max(0, int(np.ceil(budget)) - 1)
        cut, below, at = value_at_rank(phi.select(_dot(F.col("phi"), w).alias("s")), "s", rank, n)
        share = max(0.0, min(1.0, (budget - below) / at))

        def weight(x, w=w, cut=cut, share=share):
            s = x @ w
            return np.where(s < cut - 1e-12, 1.0, np.where(s <= cut + 1e-12, share, 0.0))

        v = summed(weight)
        rho = float(cut)
        gap, span = float(w @ (w - v)), float((w - v) @ (w - v))
        if gap <= 1e-6 * max(1.0, float(w @ w)) or span == 0:
            met = True
            break
        every, own, toward = np.vstack([atoms, v]), share_of, min(1.0, gap / span)
        atoms, share_of = _nearest_to_zero(every, np.append(share_of, 0.0))
        if np.linalg.norm(share_of @ atoms) >= np.linalg.norm(w):  # a plain step toward the new atom always shortens
            atoms, share_of = every, np.append(own * (1 - toward), toward)
        w = share_of @ atoms
    phi.unpersist()
    if not met:
        if passes is None:
            raise RuntimeError(f"the duality gap does not meet its tolerance after {MAX_PASSES} passes")
        warnings.warn(f"the duality gap does not meet its tolerance after {passes} passes", stacklevel=2)
    return w, rho


def decide_linear(phi: DataFrame, w: np.ndarray, rho: float) -> DataFrame:
    return phi.select(*[c for c in phi.columns if c != "phi"], (_dot(F.col("phi"), w) - rho).alias("decision"))
