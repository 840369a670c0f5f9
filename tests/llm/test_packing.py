"""Packing: every piece once, no gap and no overflow, few sequences, many ranges, pieces all of one size."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    """How many sequences the sequential method takes."""
    gaps, opened = [0] * (capacity + 1), 0
    for n in sorted(lengths, reverse=True):
        room = next((c for c in range(n, capacity) if gaps[c]), None)
        if room is None:
            opened, room = opened + 1, capacity
        else:
            gaps[room] -= 1
        gaps[room - n] += 1
    return opened


def check(packed, capacity):
    rows = packed.collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return rows, len(by)


@pytest.mark.parametrize("rows", [1 << 16, 40])
@pytest.mark.parametrize("kind", ["mixed", "small", "equal", "half", "full"])
def test_pack(spark, monkeypatch, kind, rows):
    monkeypatch.setattr(packing, "ROWS", rows)
    r = random.Random(3)
    size = {"mixed": lambda: min(100, 1 + int(r.expovariate(0.03))), "small": lambda: r.choice((1, 1, 1, 2, 3)), "equal": lambda: 7, "half": lambda: r.choice((50, 51, 49, 100)), "full": lambda: 100}[kind]
    lengths = [size() for _ in range(600)]
    packed = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "name long, length long").repartition(4), 100)
    got, n = check(packed, 100)
    assert sorted((x.name, x.length) for x in got) == list(enumerate(lengths))
    assert n <= best_fit_decreasing(lengths, 100) + 2


def test_sweep_takes_several_and_keeps_order():
    takes, waiting, gaps = packing.sweep([(0, 2, 0, 0, 1), (0, 3, 0, 1, 5), (1, 10, 0, 6, 2)])
    assert takes == [(0, 3, 3, 3, 0, 6, 0, 3), (0, 1, 2, 2, 0, 7, 0, 3), (0, 0, 1, 1, 0, 7, 6, 2)]
    assert waiting == [] and sorted(gaps) == [(0, 6, 1, 1, 10), (0, 7, 1, 2, 10)]


def test_documents(spark):
    texts = [None, "", "one two", "word " * 700, "é" * 5000, "one two", " ".join(f"w{i * i}" for i in range(9000))] + [f"text number {i} " * (i % 40) for i in range(60)]
    docs = spark.createDataFrame([(None if i == 5 else i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS piece", "3 AS tokens", "4 AS uid")
    packed = packing.pack(packing.cut(docs.repartition(3), PATH, capacity=64, with_tokens=True), 64)
    rows, n = check(packed, 64)
    tokenizer, want = Tokenizer.from_file(PATH), []
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64)]
        want += [(None if i == 5 else i % 50, k, s, tuple(ids[s : (cuts + [len(ids)])[k + 1]])) for k, s in enumerate(cuts)]
    assert sorted(((r.id, r.piece, r.start, tuple(r.tokens)) for r in rows), key=str) == sorted(want, key=str)
    whole = {r.sequence: list(r.tokens) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence][r.offset : r.offset + r.length] == list(r.tokens)
    assert packing.pack(packing.cut(docs.limit(0), PATH), 1024).count() == 0
    with pytest.raises(ValueError):
        packing.pack(packed, 64)


def test_range_lookup():
    find = packing._Lookup([(1, 5, 2), (0, 3, 1), (1, 9, 4)])
    held, which = find(np.array([0, 0, 1, 1, 1, 1, 2]), np.array([2, 3, 4, 6, 7, 12, 5]))
    assert held.tolist() == [1, 3, 5] and which.tolist() == [1, 0, 2]
