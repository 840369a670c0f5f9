"""Ranked search against plain scoring: ties, repeats, nulls, hot terms, stretches and blocks."""

import random

import numpy as np
import pytest

from helixframe.llm import rank_search

from . import brute
from .test_text_operators import odd_texts


def _tables(seed=5, n=120):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "aBé日" for b in "xyz09"] + ["the"] * 20
    text = lambda m: r.choice((" ", "-", "\x00\n")).join(r.choice(vocabulary) for _ in range(r.randint(0, m)))
    docs = [(i, text(60)) for i in range(n)] + [(n + i, t) for i, t in enumerate(odd_texts(30))]
    docs += [(n + 40, None), (n + 41, ""), (3, docs[7][1]), (3, docs[7][1]), (None, docs[7][1]), (None, docs[9][1]), (n + 50, "the " * 20_000 + "aX")]
    docs += [(n + 60 + i, docs[11][1]) for i in range(50)]
    items = [(i, text(12)) for i in range(15)] + [(3, "aX aX the"), (3, "aX aX the"), (None, "Bz"), (90, None), (91, ""), (92, "never seen"), (93, docs[11][1])]
    return docs, items


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item"], []).append((r["rank"], r["id"], r.score))
    return {i: sorted(x, key=str) for i, x in out.items()}


@pytest.mark.parametrize("triples,block_bytes", [(1 << 20, 16 << 20), (50, 16 << 20), (300, 60)])
def test_against_plain_scoring(spark, monkeypatch, triples, block_bytes):
    monkeypatch.setattr(rank_search, "TRIPLES", triples)
    docs, items = _tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS score", "4 AS terms").repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS no", "2 AS item")
    got = _found(rank_search.search(d, q, k=7, block_bytes=block_bytes))
    want = {}
    for (i, _), best in zip(items, brute.rank_search(docs, items, 7)):
        want.setdefault(i, []).extend(best)
    assert got == {i: sorted(x, key=str) for i, x in want.items() if x}


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "w w"), ("a", "w w"), ("é", "w w"), (None, "w w"), ("c", "v")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "w")], "item_id string, text string")
    assert [(r["rank"], r["id"]) for r in rank_search.search(docs, items, k=3).orderBy("rank").collect()] == [(1, None), (2, "a"), (3, "b")]
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs, items.selectExpr("item_id", "'' AS text"))):
        found = rank_search.search(d, q)
        assert found.columns == ["item", "rank", "id", "score"] and found.count() == 0


def test_radix_order_and_shared_hashes():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64) >> np.random.default_rng(2).integers(0, 60, 5000).astype(np.uint64)
    assert (rank_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    index = rank_search.Index.of(["aa bb", "bb cc"])
    index.keys[:] = index.keys[0]  # all terms share a hash: bytes decide
    index.__post_init__()

    class Same(rank_search.Words):
        def hashes(self):
            return np.full(len(self.starts), index.keys[0])

    data = np.frombuffer(b"cc aa dd bb aa", np.uint8)
    word, term = index.lookup(Same(data, np.array([0, len(data)]), rank_search._ALNUM))
    names = [bytes(index.data[a : a + n]) for a, n in zip(index.at, index.size)]
    assert sorted(zip(word.tolist(), [names[t] for t in term])) == [(0, b"cc"), (1, b"aa"), (3, b"bb"), (4, b"aa")]
