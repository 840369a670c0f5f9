"""Substring dedup on a compacted De Bruijn graph of word k-mers.

Every window of `n` words is an edge between the words before and after it. A document is a walk, cut into paths:
maximal runs of windows that share one minimiser (the smallest hash of `seed` consecutive words inside the window,
leftmost on ties). Equal windows have equal minimisers, so a path's edges can only meet edges of paths under the
same minimiser, and interior paths of two copies of a passage are equal as wholes.

1. Compaction: paths are grouped by minimiser. One that occurs once is unique. One whose paths are all equal is a
   nonbranching repeat: all its edges repeat, and it is settled without looking at single edges.
2. Branches: only where different paths meet under one minimiser are their edges hashed one by one and counted.
3. Coordinates: repeated paths and edges go back to their documents as (row, first window, windows) and are checked
   there by a second, independent hash before their words are removed.

Grouping keys are aggregated before they are shuffled, no group is ever collected, and a frequent passage's rows
meet one row of statistics, a table of its own, in a join whose large partitions Spark splits. Text moves once, to meet its own coordinates.

Null and empty texts have no words. A row is known by its id and a hash of its text: equal rows are different
sources (so their windows repeat) and get equal results. Ids may be null. Very long texts are scanned whole, in memory one at
a time; an empty table gives an empty one. Ties between minimisers go to the left. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sequences, Words, covered, saved, slices, starts_of, word_table

_SPACE = word_table("space")
SEED = 8


def paths_of(w: Words, hashes: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, ...]:
    """(minimiser, first window as a word index, number of windows) of each path in some documents."""
    at = starts_of(w.first, n)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    total = len(hashes)
    grams = Sequences(hashes, 1)
    g = np.arange(total - seed + 1)
    values = grams.of(g, g + seed)
    span = n - seed + 1
    least = np.empty(len(at), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, span)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        lo, hi = part[0], part[-1] + 1
        least[i : i + (1 << 16)] = (np.argmin(view[lo:hi], axis=1) + np.arange(lo, hi))[part - lo]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return values[least[first]], at[first], np.diff(np.append(first, len(at)))


def _scan(text_cols: pa.RecordBatch, n: int, seed: int):
    for i, j, w in slices(text_cols.column(2), _SPACE):
        h = w.hashes()
        low, at, count = paths_of(w, h, n, seed)
        if len(at):
            doc = np.searchsorted(w.first, at, "right") - 1
            end = at + count + n - 1
            yield i, w, low, doc, at - w.first[doc], count, Sequences(h, 0).of(at, end), Sequences(h, 1).of(at, end)


def _take(col: pa.Array, at: np.ndarray) -> pa.Array:
    return col.take(pa.array(at))


def _paths(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """(id, mark, low, place, path, proof): a row for each path; place holds its first window's word and its windows (at most n)."""
    kind = rows.schema["id"].dataType.simpleString()

    def emit(batches):
        for b in batches:
            for i, _, low, doc, first, count, path, proof in _scan(b, n, seed):
                at = doc + i
                yield pa.RecordBatch.from_arrays([_take(b.column(0), at), _take(b.column(1), at), pa.array(low.view(np.int64)), pa.array((first << 20) | count), pa.array(path.view(np.int64)), pa.array(proof.view(np.int64))], ["id", "mark", "low", "place", "path", "proof"])

    return rows.mapInArrow(emit, f"id {kind}, mark bigint, low bigint, place bigint, path bigint, proof bigint")


def _kept(w: Words, k: int, gone: np.ndarray) -> tuple[int, int, str]:
    """(words, removed words, digest of the rest) of a document."""
    return len(gone), int(gone.sum()), hashlib.sha256(w.text(k, ~gone)).hexdigest()


def _settle(joined: DataFrame, n: int) -> DataFrame:
    """Documents with their whole repeats and the hashes of their doubtful windows.

    A document without doubtful windows is finished here: its text goes no further.
    """
    kind = joined.schema["id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            plain = b.column(3).to_pylist()
            branch = b.column(4).to_pylist()
            count, gone, sha, text, spans, at_, h0_, h1_ = [], [], [], [], [], [], [], []
            for i, j, w in slices(b.column(2), _SPACE):
                h = None
                for k in range(j - i):
                    a = int(w.first[k])
                    size = int(w.first[k + 1]) - a
                    whole = np.unique(np.array(plain[i + k] or [], np.int64))
                    open_ = np.unique(np.array(branch[i + k] or [], np.int64))
                    s = whole >> 20
                    e = np.minimum(s + (whole & 0xFFFFF) + n - 1, size)
                    if len(open_):
                        if h is None:
                            h = w.hashes()
                            one, two = Sequences(h, 0), Sequences(h, 1)
                        at = np.unique(np.concatenate([np.arange(p >> 20, (p >> 20) + (p & 0xFFFFF)) for p in open_.tolist()]))
                        count.append(size)
                        gone.append(None)
                        sha.append(None)
                        text.append(w.data[w.offs[k] : w.offs[k + 1]].tobytes().decode())
                        spans.append([(int(x) << 32) | int(y) for x, y in zip(s, e)])
                        at_.append(at.tolist())
                        h0_.append(one.of(a + at, a + at + n).view(np.int64).tolist())
                        h1_.append(two.of(a + at, a + at + n).view(np.int64).tolist())
                    else:
                        c, g, x = _kept(w, k, covered(size, s, e))
                        count.append(c)
                        gone.append(g)
                        sha.append(x)
                        for col in (text, spans, at_, h0_, h1_):
                            col.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()), *[pa.array(c, longs) for c in (spans, at_, h0_, h1_)]], ["id", "mark", "n_words", "n_removed", "kept_sha256", "text", "spans", "at", "h0", "h1"])

    return joined.mapInArrow(work, f"id {kind}, mark bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string, spans array<bigint>, at array<bigint>, h0 array<bigint>, h1 array<bigint>")


def _finish(rows: DataFrame, n: int) -> DataFrame:
    """Doubtful documents with the places of their repeated windows: remove the words."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            spans, hits = b.column(3).to_pylist(), b.column(4).to_pylist()
            count, gone, sha = [], [], []
            for i, j, w in slices(b.column(2), _SPACE):
                for k in range(j - i):
                    size = int(w.first[k + 1] - w.first[k])
                    s = np.array(spans[i + k] or [], np.int64)
                    at = np.unique(np.array(hits[i + k] or [], np.int64))
                    c, g, x = _kept(w, k, covered(size, np.concatenate([s >> 32, at]), np.concatenate([s & 0xFFFFFFFF, at + n])))
                    count.append(c)
                    gone.append(g)
                    sha.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["id", "mark", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(work, f"id {kind}, mark bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 35, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row: words left when all words of repeated windows are gone."""
    if not 1 <= seed <= n:
        raise ValueError("the seed is part of the window")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    paths = _paths(rows, n, seed)
    stats = paths.groupBy("low").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in ("path", "proof") for k, f in (("least", F.min), ("most", F.max))])
    repeated = saved(stats.filter("n > 1").select("low", ((F.col("path_least") == F.col("path_most")) & (F.col("proof_least") == F.col("proof_most"))).alias("plain")), "repeated")
    found = paths.select("id", "mark", "low", "place").join(repeated, "low")
    by_row = found.groupBy("id", "mark").agg(F.collect_set(F.when(F.col("plain"), F.col("place"))).alias("plain"), F.collect_set(F.when(~F.col("plain"), F.col("place"))).alias("branch"))
    r, f = rows.alias("r"), by_row.alias("f")
    joined = r.join(f, F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.mark") == F.col("f.mark")), "left").select("r.id", "r.mark", "r.text", "f.plain", "f.branch")
    settled = saved(_settle(joined, n), "settled")
    open_ = settled.filter(F.col("text").isNotNull())
    windows = open_.select("id", "mark", F.explode(F.arrays_zip("at", "h0", "h1")).alias("w")).select("id", "mark", "w.at", "w.h0", "w.h1")
    twice = saved(windows.groupBy("h0", "h1").agg(F.count("*").alias("n")).filter("n > 1").select("h0", "h1"), "twice")
    hits = windows.join(twice, ["h0", "h1"]).groupBy("id", "mark").agg(F.collect_set("at").alias("hits"))
    o, h = open_.select("id", "mark", "text", "spans").alias("o"), hits.alias("h")
    last = o.join(h, F.col("o.id").eqNullSafe(F.col("h.id")) & (F.col("o.mark") == F.col("h.mark")), "left").select("o.id", "o.mark", "o.text", "o.spans", "h.hits")
    done = settled.filter(F.col("text").isNull()).select("id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(_finish(last, n).select("id", "n_words", "n_removed", "kept_sha256")).withColumnRenamed("id", id_col)
