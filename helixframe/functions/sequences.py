"""k-mers, mismatch neighbourhoods, vocabularies and kernel weights as expressions.

A k-mer's neighbourhood holds every string of the alphabet's letters within `m` substitutions. Weights decay by
distance in powers of a half, so their sums are exact whatever the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = ("A", "C", "G", "T", "M", "H")


def kmers(seq: Column, k: int) -> Column:
    """All windows of k letters, by one scan; none if the sequence is shorter."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def neighbourhood(kmer: Column, k: int, m: int = 1, alphabet: tuple[str, ...] = ALPHABET) -> Column:
    """Distinct strings within m substitutions (the k-mer itself first, as it is)."""
    letters = F.array(*[F.lit(a) for a in alphabet])

    def replaced(s: Column, p: int) -> Column:
        return F.transform(letters, lambda a: F.overlay(s, a, F.lit(p), F.lit(1)))

    out = F.array(kmer)
    for _ in range(m):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.flatten(F.array(*[replaced(s, p) for p in range(1, k + 1)]))))))
    return out


def hamming(a: Column, b: Column, k: int) -> Column:
    return sum((F.substring(a, p, 1) != F.substring(b, p, 1)).cast("int") for p in range(1, k + 1))


def weighted_neighbourhood(kmer: Column, k: int, m: int = 1, alphabet: tuple[str, ...] = ALPHABET) -> Column:
    """array<struct(neighbor, dist)>"""
    return F.transform(neighbourhood(kmer, k, m, alphabet), lambda n: F.struct(n.alias("neighbor"), hamming(kmer, n, k).alias("dist")))


def in_vocabulary(kmer: Column, k: int, alphabet: tuple[str, ...] = ALPHABET) -> Column:
    return kmer.rlike(f"^[{''.join(alphabet)}]{{{k}}}$")


def code(kmer: Column, k: int, alphabet: tuple[str, ...] = ALPHABET) -> Column:
    """The k-mer's place in the full vocabulary: its letters as digits."""
    letters = "".join(alphabet)
    value = F.lit(0).cast("long")
    for p in range(1, k + 1):
        value = value * len(alphabet) + F.call_function("instr", F.lit(letters), F.substring(kmer, p, 1)) - 1
    return value.cast("long")


def full_vocabulary(spark: SparkSession, k: int, alphabet: tuple[str, ...] = ALPHABET) -> DataFrame:
    """(kmer, col) of every string of k letters, numbered in order of the alphabet."""
    n = len(alphabet)
    letters = F.array(*[F.lit(a) for a in alphabet])
    digits = [F.element_at(letters, (F.floor(F.col("col") / n**p) % n + 1).cast("int")) for p in reversed(range(k))]
    return spark.range(n**k).select(F.col("id").alias("col")).select(F.concat(*digits).alias("kmer"), "col")


def kernel_weights(max_k: int, noise_threshold: int = 2, scaling: str = "linear") -> list[float]:
    """A weight for each k: none up to the threshold, then growing linearly or quadratically; they sum to 1 (4 decimals each)."""
    power = {"linear": 1, "quadratic": 2}.get(scaling)
    if power is None:
        raise ValueError(f"unknown scaling: {scaling}")
    raw = [float(max(k - noise_threshold, 0) ** power) for k in range(1, max_k + 1)]
    return [round(x / sum(raw), 4) for x in raw] if sum(raw) else [0.0] * max_k


def weights_or_default(max_k: int, mismatches: int, weights: list[float] | None = None) -> list[float]:
    return kernel_weights(max_k, max(1, 2 * mismatches)) if weights is None else weights


def active_ks(max_k: int, mismatches: int, weights: list[float]) -> list[int]:
    """Lengths that count: a weight, and more letters than mismatches."""
    return [k for k in range(mismatches + 1 if mismatches else 1, max_k + 1) if weights[k - 1] != 0]


def short_name(file: Column) -> Column:
    """The first two parts of a name, or all of it."""
    return F.when(F.size(F.split(file, "_")) >= 2, F.substring_index(file, "_", 2)).otherwise(file)


def healthy_tag(file: Column) -> Column:
    """H3 of Healthy_3_..."""
    return F.concat(F.lit("H"), F.get(F.split(file, "_"), F.lit(1)))


def fold_name(patient: Column) -> Column:
    return F.concat(F.lit("LOO_"), patient)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w\-.]", "_")
