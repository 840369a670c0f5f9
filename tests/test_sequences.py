"""k-mers, neighbourhoods, weights and features: sizes that combinatorics fixes, and two ways to the same value."""

import itertools
from collections import Counter
from math import comb

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import sequences as s
from helixframe.operators import features

SAMPLE = ["ATGCATGC", "GCATGCAT", "AAAAAA", "TTTTTT"]


def frame(spark, seqs):
    return spark.createDataFrame([("p", i, 1, x) for i, x in enumerate(seqs)], "patient string, read_idx long, label int, seq string")


def plain(seq, k, m, decay=0.5):
    out = Counter()
    for i in range(len(seq) - k + 1):
        a = seq[i : i + k]
        for b in map("".join, itertools.product(s.ALPHABET, repeat=k)):
            d = sum(x != y for x, y in zip(a, b))
            if d <= m:
                out[b] += decay**d
    return out


@pytest.mark.parametrize("kmer,m,n", [("AAA", 0, 1), ("AAA", 1, 13), ("AA", 2, 25)])
def test_neighbourhood_sizes(spark, kmer, m, n):
    five = ("A", "C", "G", "T", "M")
    got = spark.range(1).select(s.neighbourhood(F.lit(kmer), len(kmer), m, five).alias("x")).first().x
    assert len(got) == len(set(got)) == n == sum(comb(len(kmer), d) * 4**d for d in range(m + 1)) and kmer in got


def test_token_count(spark):
    assert features.mismatch_counts(frame(spark, ["ATGC"]), 3).agg(F.sum("cnt")).first()[0] == 32


def test_short_empty_and_null_reads(spark):
    assert features.kmer_counts(frame(spark, ["", "AT", None, "ATG", "atg"]), 3).select("kmer").collect() == [("ATG",), ("ATG",)]


@pytest.mark.parametrize("k,m", [(2, 1), (3, 1), (3, 2)])
def test_weights_equal_plain_version(spark, k, m):
    seqs = [*SAMPLE, "ATNGC", "MHMHA"]
    got = {(r.read_idx, r.kmer): r.w for r in features.weighted_features(frame(spark, seqs), k, m).collect()}
    want = {(i, b): w for i, q in enumerate(seqs) for b, w in plain(q, k, m).items()}
    assert got == want


def test_no_mismatch_keeps_unknown_letters(spark):
    got = {r.kmer for r in features.weighted_features(frame(spark, ["ATNG"]), 3, 0).collect()}
    assert got == {"ATN", "TNG"}


def test_weights():
    assert s.kernel_weights(5) == [0, 0, 0.1667, 0.3333, 0.5]
    assert s.kernel_weights(4, 2, "quadratic") == [0, 0, 0.2, 0.8]
    assert s.kernel_weights(2) == [0, 0]
    assert s.weights_or_default(4, 0) == s.kernel_weights(4, 1)
    assert s.active_ks(3, 1, [0.1, 0.4, 0.5]) == [2, 3]
    with pytest.raises(ValueError):
        s.kernel_weights(3, scaling="cubic")


def test_no_active_k(spark):
    with pytest.raises(ValueError):
        features.combined_features(frame(spark, SAMPLE), 2, 1, [1.0, 0.0])


def test_vocabulary(spark):
    rows = s.full_vocabulary(spark, 3).collect()
    assert [r.kmer for r in sorted(rows, key=lambda r: r.col)] == ["".join(x) for x in itertools.product(s.ALPHABET, repeat=3)]
    assert spark.createDataFrame([(r.kmer, r.col) for r in rows], "kmer string, col long").filter(s.code(F.col("kmer"), 3) != F.col("col")).count() == 0


def test_names(spark):
    row = spark.createDataFrame([("Healthy_3_merged.fa",), ("solo",)], "f string").select(s.short_name(F.col("f")).alias("a"), s.healthy_tag(F.col("f")).alias("b"), s.safe_file_name(F.lit("a b/c.d")).alias("c"), s.fold_name(F.col("f")).alias("d")).collect()
    assert [tuple(r) for r in row] == [("Healthy_3", "H3", "a_b_c.d", "LOO_Healthy_3_merged.fa"), ("solo", None, "a_b_c.d", "LOO_solo")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ACGTMHN", max_size=9), min_size=1, max_size=6))
def test_counts_property(spark, seqs):
    got = {(r.read_idx, r.kmer): r.cnt for r in features.kmer_counts(frame(spark, seqs), 3).collect()}
    want = {(i, k): n for i, q in enumerate(seqs) for k, n in Counter(q[j : j + 3] for j in range(len(q) - 2)).items()}
    assert got == want
