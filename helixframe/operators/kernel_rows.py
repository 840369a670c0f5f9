"""Rows of a kernel between many reads, made on the executors when a solver asks for them; no table of all pairs exists.

Reads are stored once with a number; the driver knows the counts of the stored partitions, so a read's place among all
(0 to n - 1) follows from its number without a sort or a join. What a solver holds is arrays of one number a read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from . import features as feats
from . import kernels

_MASK = np.int64((1 << 33) - 1)
#: Vectors that are sent to all executors at once.
CHUNK = 1024


def _places(row: np.ndarray, parts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return starts[np.searchsorted(parts, row >> 33)] + (row & _MASK)


class KernelRows:
    """Stored reads (id, x), and a function that gives the kernel values of two sets of them."""

    def __init__(self, reads: DataFrame, product: Callable[[pa.ChunkedArray, pa.ChunkedArray], np.ndarray]):
        self.stored = saved(reads.select("id", "x").withColumn("row", F.monotonically_increasing_id()), "reads")
        self.product, self.spark = product, reads.sparkSession
        counts = sorted(self.stored.groupBy(F.shiftright("row", 33).alias("part")).count().collect())
        self.parts = np.array([r[0] for r in counts], np.int64)
        self.starts = np.cumsum([0] + [r[1] for r in counts])
        self.n = int(self.starts[-1])
        self.computed = 0

    def places(self, row: np.ndarray) -> np.ndarray:
        return _places(row, self.parts, self.starts)

    def numbers(self, place: np.ndarray) -> np.ndarray:
        part = np.searchsorted(self.starts, place, "right") - 1
        return (self.parts[part] << 33) + place - self.starts[part]

    def _chosen(self, which: np.ndarray) -> pa.ChunkedArray:
        """x of some places, in their order."""
        t = self.stored.filter(F.col("row").isin(self.numbers(which).tolist())).select("row", "x").toArrow()
        order = np.argsort(self.places(np.asarray(t["row"])))
        return t["x"].take(pa.array(order[np.argsort(np.argsort(which))]))

    vectors_at = _chosen

    def _map(self, f: Callable[[np.ndarray, pa.Table], Iterator[tuple[np.ndarray, pa.Array]]], kind: str, active: np.ndarray | None = None) -> pa.Table:
        """(place, value) of f over blocks of reads, of those at `active` places only."""
        parts, starts = self.parts, self.starts
        mask = None if active is None else self.spark.sparkContext.broadcast(np.packbits(active))

        def work(batches):
            for b in batches:
                at = _places(np.asarray(b.column(0)), parts, starts)
                if mask is not None:
                    keep = np.flatnonzero(mask.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                    at, b = at[keep], b.take(pa.array(keep))
                for i in range(0, b.num_rows, kernels.BLOCK):
                    part = pa.Table.from_batches([b.slice(i, kernels.BLOCK)])
                    yield pa.RecordBatch.from_arrays([pa.array(at[i : i + kernels.BLOCK]), f(at[i : i + kernels.BLOCK], part["x"])], ["place", "value"])

        out = self.stored.select("row", "x").mapInArrow(work, f"place bigint, value {kind}").toArrow()
        if mask is not None:
            mask.destroy()
        return out

    def rows(self, which: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Kernel values of the reads at places `which` with those at the ascending places `active`: a row for each of `which`."""
        q, product = self.spark.sparkContext.broadcast(self._chosen(which)), self.product
        flags = None if len(active) == self.n else np.isin(np.arange(self.n), active)
        t = self._map(lambda _, x: pa.array(list(product(x, q.value)), pa.list_(pa.float64())), "array<double>", flags)
        self.computed += len(which)
        q.destroy()
        values = np.asarray(t["value"].combine_chunks().flatten()).reshape(-1, len(which))
        return values[np.argsort(np.asarray(t["place"]))].T

    def combine(self, alpha: np.ndarray) -> np.ndarray:
        """The kernel times alpha, a number a read; support vectors go out in chunks."""
        out, product = np.zeros(self.n), self.product
        support = np.flatnonzero(alpha)
        for i in range(0, len(support), CHUNK):
            which = support[i : i + CHUNK]
            q, a = self.spark.sparkContext.broadcast(self._chosen(which)), alpha[which]
            t = self._map(lambda _, x, q=q, a=a: pa.array(product(x, q.value) @ a), "double")
            out[np.asarray(t["place"])] += np.asarray(t["value"])
            q.destroy()
        return out

    def diagonal(self) -> np.ndarray:
        """Each read's kernel value with itself."""
        product = self.product
        t = self._map(lambda _, x: pa.array([float(product(x.slice(i, 1), x.slice(i, 1))[0, 0]) for i in range(len(x))], pa.float64()), "double")
        out = np.zeros(self.n)
        out[np.asarray(t["place"])] = np.asarray(t["value"])
        return out

    def with_alpha(self, alpha: np.ndarray) -> DataFrame:
        """(id, alpha) of the support vectors."""
        support = np.flatnonzero(alpha)
        pairs = self.spark.createDataFrame(pa.table({"row": self.numbers(support), "alpha": alpha[support]}))
        return self.stored.select("row", "id").join(pairs, "row").select("id", "alpha")


class StringRows(KernelRows):
    """Reads under a normalised multi-k string kernel; those without a feature have kernel value 0 with every read, themselves included."""

    def __init__(self, reads: DataFrame, features: DataFrame, weights: dict[int, float]):
        self.weights = weights
        own = kernels.vectors(features, weights)
        rows = reads.select(F.struct(*feats.READ).alias("id")).distinct().join(own, "id", "left")
        empty = F.array().cast(own.schema["vectors"].dataType)

        def product(a, b):
            return kernels.product(a, b, weights) / np.outer(kernels.norms(a, weights), kernels.norms(b, weights))

        super().__init__(rows.select("id", F.coalesce("vectors", empty).alias("x")), product)

    def combine(self, alpha: np.ndarray) -> np.ndarray:
        """The kernel is linear in unit features: support vectors are summed by string once, and every read meets that sum."""
        sc, weights = self.spark.sparkContext, self.weights
        shared, parts, starts = sc.broadcast(alpha), self.parts, self.starts

        def add(batches):
            sums: dict[tuple[int, int], float] = {}
            for b in batches:
                row = np.asarray(b.column(0))
                a = shared.value[_places(row, parts, starts)]
                some = np.flatnonzero(a)
                for i in range(0, len(some), kernels.BLOCK):
                    x = pa.chunked_array([b.column(1).take(pa.array(some[i : i + kernels.BLOCK]))])
                    n, own, k, col, value = kernels._flat(x)
                    value = value * (a[some[i : i + kernels.BLOCK]] / kernels.norms(x, weights))[own]
                    for kk in weights:
                        cols, at = np.unique(col[k == kk], return_inverse=True)
                        for c, v in zip(cols.tolist(), np.bincount(at, value[k == kk], len(cols)).tolist()):
                            sums[kk, c] = sums.get((kk, c), 0.0) + v
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sums], pa.int32()), pa.array([x[1] for x in sums], pa.int64()), pa.array(list(sums.values()), pa.float64())], ["k", "col", "v"])

        t = self.stored.select("row", "x").mapInArrow(add, "k int, col bigint, v double").groupBy("k", "col").agg(F.sum("v").alias("v")).orderBy("k", "col").toArrow()
        k, col, v = (np.asarray(t[c]) for c in ("k", "col", "v"))
        vector = sc.broadcast({kk: (col[k == kk], v[k == kk] * w) for kk, w in weights.items()})

        def dot(_, x):
            n, own, kind, place, value = kernels._flat(x)
            total = np.zeros(n)
            for kk, (cols, weight) in vector.value.items():
                if len(cols):
                    mine = kind == kk
                    at = np.minimum(np.searchsorted(cols, place[mine]), len(cols) - 1)
                    hit = cols[at] == place[mine]
                    total += np.bincount(own[mine][hit], (value[mine] * weight[at])[hit], n)
            return pa.array(total / kernels.norms(x, weights))

        t = self._map(dot, "double")
        shared.destroy()
        vector.destroy()
        out = np.zeros(self.n)
        out[np.asarray(t["place"])] = np.asarray(t["value"])
        return out


class EmbeddingRows(KernelRows):
    """Rows (id, embedding) under a linear or RBF kernel."""

    def __init__(self, rows: DataFrame, kind: str = "linear", gamma: float | None = None):
        if kind not in ("linear", "rbf"):
            raise ValueError(f"unknown kernel: {kind}")
        gamma = kernels.embedding_gamma(rows) if kind == "rbf" and gamma is None else gamma

        def product(a, b):
            x, y = (np.asarray(v.combine_chunks().flatten(), np.float64).reshape(len(v), -1) for v in (a, b))
            g = x @ y.T
            return g if kind == "linear" else np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * g, 0))

        super().__init__(rows.select("id", F.col("embedding").cast("array<double>").alias("x")), product)
        self.blocked = None

    def combine(self, alpha: np.ndarray) -> np.ndarray:
        """The kernel times alpha in one pass, however many support vectors: stored blocks of rows meet where they are, and the driver sends
        and takes a number a row."""
        support = np.flatnonzero(alpha)
        if len(support) <= CHUNK:
            return super().combine(alpha)
        if self.blocked is None:
            rows = self.stored.select(F.col("row").alias("id"), F.col("x"))
            width = self.stored.agg(F.coalesce(F.max(F.size("x")), F.lit(1))).first()[0]
            self.blocked = kernels.blocks(rows, max(1, -(-self.n // kernels.MOST_ROWS), -(-8 * self.n * width // kernels.MOST_BYTES)))
        shared, product, parts, starts = self.spark.sparkContext.broadcast(alpha), self.product, self.parts, self.starts

        def add(batches):
            for _, _, a, b in kernels.met(batches):
                weight = shared.value[_places(np.asarray(b["id"]), parts, starts)]
                some = np.flatnonzero(weight)
                if not len(some):
                    continue
                b, weight = b["x"].take(pa.array(some)), weight[some]
                for i in range(0, a.num_rows, kernels.BLOCK):
                    u = a.slice(i, kernels.BLOCK)
                    dots = sum(product(u["x"], b.slice(j, kernels.BLOCK)) @ weight[j : j + kernels.BLOCK] for j in range(0, len(some), kernels.BLOCK))
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(u["id"])), pa.array(dots)], ["row", "dot"])

        t = kernels.meet(self.blocked, self.blocked).mapInArrow(add, "row bigint, dot double").groupBy("row").agg(F.sum("dot").alias("dot")).toArrow()
        shared.destroy()
        out = np.zeros(self.n)
        out[self.places(np.asarray(t["row"]))] = np.asarray(t["dot"])
        return out
