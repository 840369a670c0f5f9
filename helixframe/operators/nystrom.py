"""Low-rank kernel maps: landmarks, the inverse square root of their kernel, and each read's projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import ALPHABET
from . import features as feats
from . import kernels, sampling

MAX_LANDMARKS = 4000


@dataclass
class NystromState:
    """Landmarks (in order) with their features, W^-1/2, and the kernel's parameters: all that a projection needs."""

    landmarks: pa.Table  # (id, vectors), one row a landmark
    inverse_root: np.ndarray
    weights: dict[int, float]
    kept: int

    @property
    def order(self) -> list[tuple]:
        return [(r["patient"], r["read_idx"]) for r in self.landmarks["id"].to_pylist()]

    @property
    def n_components(self) -> int:
        return self.landmarks.num_rows

    def tables(self, spark: SparkSession) -> tuple[dict, dict[str, DataFrame]]:
        """(params, tables) as `sources.model_store` keeps them."""
        t = self.landmarks.append_column("place", pa.array(range(self.n_components), pa.int32())).append_column("root", pa.array(list(self.inverse_root), pa.list_(pa.float64())))
        return {"kernel_weights": {str(k): w for k, w in self.weights.items()}, "kept": self.kept}, {"landmarks": spark.createDataFrame(t)}

    @classmethod
    def of(cls, params: dict, tables: dict[str, DataFrame]) -> NystromState:
        """The state that `tables` gave: at most MAX_LANDMARKS rows."""
        t = tables["landmarks"].limit(MAX_LANDMARKS).toArrow().sort_by("place")
        return cls(t.select(["id", "vectors"]), np.array(t["root"].to_pylist()), {int(k): w for k, w in params["kernel_weights"].items()}, params["kept"])


def inverse_root(w: np.ndarray) -> tuple[np.ndarray, int]:
    """(W^-1/2, eigenvalues kept): those under 1e-12 of the largest are left out."""
    values, vectors = np.linalg.eigh(w)
    top = np.abs(values).max()
    ok = values > (1e-12 * top if top > 0 else 1e-12)
    scale = np.zeros_like(values)
    scale[ok] = 1 / np.sqrt(values[ok])
    return (vectors * scale) @ vectors.T, int(ok.sum())


def fit(reads: DataFrame, features: DataFrame, weights: dict[int, float], m: int, seed: int = 42) -> NystromState:
    """Choose m landmarks by digest order (at most reads - 1) and decompose their kernel on the driver, m by m.

    A chosen read without features would be at kernel 0 with every other, and is left out.
    """
    n = reads.count()
    if n < 2:
        raise ValueError("landmarks need at least two reads")
    m = min(m, n - 1)
    if m > MAX_LANDMARKS:
        raise ValueError(f"the landmark kernel is decomposed on the driver: at most {MAX_LANDMARKS} landmarks")
    chosen = sampling.landmarks(reads, m, seed)
    own = kernels.vectors(features.join(F.broadcast(chosen), feats.READ, "left_semi"), weights).toArrow()
    own = own.take(pa.array(sorted(range(own.num_rows), key=lambda i: (own["id"][i].as_py()["patient"], own["id"][i].as_py()["read_idx"]))))
    length = kernels.norms(own["vectors"], weights)
    root, kept = inverse_root(kernels.product(own["vectors"], own["vectors"], weights) / np.outer(length, length))
    return NystromState(own, root, weights, kept)


def transform(features: DataFrame, state: NystromState, vocabulary: DataFrame | None = None, reads: DataFrame | None = None) -> DataFrame:
    """(patient, read_idx, phi): each read's kernel with the landmarks times W^-1/2, a block of reads at a time.

    vocabulary (k, kmer): training's strings; others are left out before norms are taken, as a fixed feature space has it.
    With `reads`, those without any feature get zeros.
    """
    known = None
    if vocabulary is not None:
        if "vectors" in features.columns:
            known = columns_of(vocabulary)
        else:
            features = features.join(vocabulary, ["k", "kmer"], "left_semi")
    rows = kernels.vectors(features, state.weights)
    marks, weights = state.landmarks["vectors"], state.weights
    scale = state.inverse_root / kernels.norms(marks, weights)[:, None]
    kind = rows.schema["id"].dataType.simpleString()

    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, kernels.BLOCK):
                part = pa.Table.from_batches([b.slice(at, kernels.BLOCK)])
                if known is not None:
                    part = part.set_column(1, "vectors", _only(part["vectors"], known))
                c = kernels.product(part["vectors"], marks, weights) / kernels.norms(part["vectors"], weights)[:, None]
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(list(c @ scale), pa.list_(pa.float64()))], ["id", "phi"])

    out = rows.mapInArrow(project, f"id {kind}, phi array<double>").select("id.patient", "id.read_idx", "phi")
    if reads is not None:
        zeros = F.array_repeat(F.lit(0.0), state.n_components)
        out = reads.select(*feats.READ).distinct().join(out, feats.READ, "left").select(*feats.READ, F.coalesce("phi", zeros).alias("phi"))
    return out


def vocabulary(features: DataFrame) -> DataFrame:
    """(k, kmer) of the strings that occur."""
    if "vectors" not in features.columns:
        return features.select("k", "kmer").distinct()

    def seen(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            _, _, k, col, _ = kernels._flat(pa.chunked_array([b.column(0)]))
            for x in np.unique(k).tolist():
                found[x] = np.union1d(found.get(x, np.zeros(0, np.int64)), col[k == x])
        for k, cols in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), k, np.int32)), feats.strings_of(k).take(pa.array(cols))], ["k", "kmer"])

    return features.select("vectors").mapInArrow(seen, "k int, kmer string").distinct()


def columns_of(vocabulary: DataFrame) -> dict[int, np.ndarray]:
    """Flags by k of the column numbers of strings of the alphabet: at most the vocabulary's size."""
    out = {}
    letters = {a: i for i, a in enumerate(ALPHABET)}
    t = vocabulary.groupBy("k", "kmer").agg(F.lit(1)).select("k", "kmer").toArrow()
    k, kmer = np.asarray(t["k"]), t["kmer"].to_pylist()
    for x in np.unique(k).tolist():
        flags = np.zeros(len(ALPHABET) ** x, bool)
        for i in np.flatnonzero(k == x).tolist():
            flags[sum(letters[a] * len(ALPHABET) ** p for p, a in enumerate(reversed(kmer[i])))] = True
        out[x] = flags
    return out


def _only(vectors: pa.ChunkedArray, known: dict[int, np.ndarray]) -> pa.Array:
    """Vectors without the columns that are not known."""
    n, row, k, col, value = kernels._flat(vectors)
    keep = np.zeros(len(row), bool)
    for x, flags in known.items():
        mine = k == x
        keep[mine] = flags[col[mine]]
    ks = sorted(known)
    return feats._lists([(row[keep & (k == x)], col[keep & (k == x)], value[keep & (k == x)]) for x in ks], ks, n)


def landmark_count(ratio: float, n: int) -> int:
    return max(1, int(ratio * n))


def intrinsic_errors(exact: DataFrame, phi: DataFrame) -> DataFrame:
    """(rel_frobenius_error, max_diag_error, mean_diag_error) of phi's kernel against exact (i, j, k), i <= j."""
    a = phi.select(F.struct(*feats.READ).alias("i"), F.col("phi").alias("a"))
    b = phi.select(F.struct(*feats.READ).alias("j"), F.col("phi").alias("b"))
    near = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = exact.join(a, "i").join(b, "j").select("k", (F.col("k") - near).alias("d"), F.when(F.col("i") == F.col("j"), 1).otherwise(2).alias("times"))
    diag = F.when(F.col("times") == 1, F.abs("d"))
    rel = F.sqrt(F.sum(F.col("times") * F.col("d") * F.col("d"))) / F.greatest(F.sqrt(F.sum(F.col("times") * F.col("k") * F.col("k"))), F.lit(1e-12))
    return d.agg(rel.alias("rel_frobenius_error"), F.max(diag).alias("max_diag_error"), F.avg(diag).alias("mean_diag_error"))


def map_errors(features: DataFrame, phi: DataFrame, weights: dict[int, float]) -> DataFrame:
    """What `intrinsic_errors` says of the normalised kernel of `features.read_vectors` of short strings, without a pair of reads.

    With X the unit features (their weights in them) and P the maps, the squares of all entries of XX' - PP' add up to those of X'X, less twice
    X'P, and P'P. So tasks add up one matrix over strings and components, whatever the number of reads.
    """
    starts, d = {}, 0
    for k in sorted(weights):
        starts[k], d = d, d + len(ALPHABET) ** k
    if d > MAX_LANDMARKS:
        raise ValueError(f"second moments hold a number for two strings: at most {MAX_LANDMARKS} strings")
    rows = kernels.vectors(features, weights).select("id.*", "vectors").join(phi, feats.READ)

    def work(batches):
        total, diag, n = None, np.zeros(2), 0
        for b in batches:
            for at in range(0, b.num_rows, kernels.BLOCK):
                part = pa.Table.from_batches([b.slice(at, kernels.BLOCK)])
                size, own, k, col, value = kernels._flat(part["vectors"])
                x, p = np.zeros((size, d)), np.asarray(part["phi"].combine_chunks().flatten()).reshape(size, -1)
                for kk, start in starts.items():
                    x[own[k == kk], start + col[k == kk]] = value[k == kk] * np.sqrt(weights[kk])
                square = (x * x).sum(1)
                x /= np.sqrt(np.maximum(square, 1e-12))[:, None]
                off = np.abs((x * x).sum(1) - (p * p).sum(1))
                diag, n = np.array([max(diag[0], off.max()), diag[1] + off.sum()]), n + size
                both = np.hstack([x, p])
                total = both.T @ both if total is None else total + both.T @ both
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.shape[0]], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([diag[0]]), pa.array([diag[1]]), pa.array([n])], names)

    names = ["width", "moments", "worst", "off", "n"]
    sums = rows.select("vectors", "phi").mapInArrow(work, "width int, moments array<double>, worst double, off double, n bigint")
    whole = sums.select("width", F.posexplode("moments").alias("at", "v")).groupBy("width", "at").agg(F.sum("v").alias("v"))
    row, col = F.floor(F.col("at") / F.col("width")) < d, F.col("at") % F.col("width") < d
    square = F.col("v") * F.col("v")
    exact = F.sum(F.when(row & col, square))
    off = F.sum(F.when(row == col, square).otherwise(-square))
    rel = F.sqrt(F.greatest(off, F.lit(0.0))) / F.greatest(F.sqrt(exact), F.lit(1e-12))
    diag = sums.agg(F.max("worst").alias("max_diag_error"), (F.sum("off") / F.sum("n")).alias("mean_diag_error"))
    return whole.agg(rel.alias("rel_frobenius_error")).join(diag, F.lit(True))


def spectral_error(exact: np.ndarray, phi: np.ndarray) -> float:
    """Relative spectral error of a sampled sub-matrix, on the driver."""
    return float(np.linalg.norm(exact - phi @ phi.T, 2) / max(np.linalg.norm(exact, 2), 1e-12))
