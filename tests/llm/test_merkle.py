"""Merkle manifests: any fanout, null and repeated ids, groups of one row, what a change does to the root."""

import pytest
from pyspark.sql import functions as F

from helixframe.llm import merkle

from . import brute

FIELDS = ["doc_id", "source", "text"]


def _rows(n):
    out = [(i, None if i % 13 == 0 else "alone" if i == 5 else f"s{i % 3 and 1}", None if i % 7 == 0 else f"Text {i % 9}é") for i in range(n)]
    return out + [(None, "s1", "x"), (None, None, "y"), (3, "s0", "A"), (3, "s0", "A"), (3, "s0", None), (3, "s0", "")]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_against_plain_trees(spark, fanout):
    rows = _rows(70)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    proofs = merkle.manifest(docs, FIELDS, fanout=fanout, other=F.when(F.col("doc_id") == 3, merkle.leaf(F.col("doc_id"), F.col("source"), F.lower("text")))).proofs()
    got = proofs.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.coalesce("other", "leaf"), F.col("path")).alias("f")).withColumn("same", F.col("f") == F.col("root")).collect()
    want = brute.merkle(rows, fanout, lambda r: (r[0], r[1], r[2] and brute.lower(r[2])) if r[0] == 3 else None)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_root_subroots_and_nodes(spark):
    docs = spark.createDataFrame(_rows(40), "doc_id long, source string, text string")
    a, b = merkle.manifest(docs, FIELDS, fanout=4), merkle.manifest(docs.repartition(7), FIELDS, fanout=4)
    assert a.root().collect() == b.root().collect() and set(a.subroots().collect()) == set(b.subroots().collect())
    assert {r.grp for r in a.subroots().collect()} == {None, "alone", "s0", "s1"}
    c = merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 8, "changed").otherwise(F.col("text"))), FIELDS, fanout=4)
    changed = c.nodes().exceptAll(a.nodes()).collect()
    assert {r.grp for r in changed if r.level > 0} == {"s1"} and sum(r.level == 1 for r in changed) == 1
    assert c.root().collect() != a.root().collect()


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "a", "t")], "doc_id long, source string, text string")
    r = merkle.manifest(docs, FIELDS).proofs().first()
    assert r.leaf == r.subroot == r.root == brute.sha("1:11:a1:t") and r.path == []
    none = merkle.manifest(docs.limit(0), FIELDS)
    assert none.root().count() == none.proofs().count() == none.nodes().count() == none.subroots().count() == 0
