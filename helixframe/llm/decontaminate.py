"""Benchmark decontamination: a broadcast hash set of benchmark word windows is matched against every document.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A benchmark item gives all
its windows of `n` consecutive words; an item of fewer words, but not none, is one window of its own length.
Training windows are hashed in place, looked up in a bit table and a sorted hash array, and each hit is verified
word by word. The index is a few flat arrays, about four times the benchmark's text. What is broadcast is bounded: benchmarks
are matched in blocks of `block_bytes` of text, `PASS_BLOCKS` of them in one pass over the documents; a larger benchmark takes
more passes, each stored before the next.

Nulls and empty texts have no words and no hits. Items of equal id count once; the windows of an item without an id hit words
like others, but name no item. Repeated rows are judged alike; a document of just one in `share` hit words is contaminated. Very long
texts are matched whole, one at a time. Empty documents or benchmarks give no rows or no hits. Columns of the documents keep
their names: the column of results takes one that none has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sequences, Words, covered, fresh, per_doc, saved, slices, starts_of, word_table

_ALNUM = word_table("alnum")
_TABLE_BITS = 20


PASS_BLOCKS = 4


class BenchmarkIndex:
    """The windows of benchmark items by length: sorted hashes, where each window's words are, and whose it is."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.names = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(self.names)}
        owner = np.array([place.get(i, -1) for i, _ in items], np.int32)
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, self.starts, self.ends, at_byte, at_word = [], [], [], 0, 0
        for i, j, w in slices(pa.array([t for _, t in items], pa.large_string()), _ALNUM, lower=True) if items else ():
            h, counts = Sequences(w.hashes()), w.counts
            for size in np.unique(np.minimum(counts, n)).tolist():
                if size:
                    at = starts_of(w.first, size)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    own = np.minimum(counts[doc], n) == size
                    at, doc = at[own], doc[own]
                    found.setdefault(size, []).append((h.of(at, at + size), at + at_word, owner[i + doc]))
            texts.append(w.data)
            self.starts.append(w.starts + at_byte)
            self.ends.append(w.ends + at_byte)
            at_byte, at_word = at_byte + len(w.data), at_word + len(w.starts)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.data, self.starts, self.ends = join(texts, np.uint8).tobytes(), join(self.starts, np.int64), join(self.ends, np.int64)
        self.lengths = []
        for size, parts in sorted(found.items()):
            keys, at, who = (np.concatenate([p[c] for p in parts]) for c in range(3))
            order = np.lexsort((at, who, keys))
            keys, at, who = keys[order], at[order], who[order]
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[keys >> np.uint64(64 - _TABLE_BITS)] = True
            self.lengths.append((size, keys, table, at, who))

    def words(self, at: int, size: int) -> bytes:
        return b" ".join([self.data[s:e] for s, e in zip(self.starts[at : at + size].tolist(), self.ends[at : at + size].tolist())])

    def match(self, w: Words) -> tuple[np.ndarray, list[set[str]]]:
        """(flags of hit words, items by document) for some documents."""
        total, ids = int(w.first[-1]), [set() for _ in range(len(w.first) - 1)]
        seq = Sequences(w.hashes())
        begin, end, raw = [], [], None
        for size, keys, table, place, who in self.lengths:
            at = starts_of(w.first, size)
            h = seq.of(at, at + size)
            near = table[h >> np.uint64(64 - _TABLE_BITS)]
            at, h = at[near], h[near]
            lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
            some = hi > lo
            seen: dict[tuple[int, bytes], tuple[bool, set[str]]] = {}
            for p, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist()):
                raw = w.data.tobytes() if raw is None else raw
                text = b" ".join([raw[s:e] for s, e in zip(w.starts[p : p + size].tolist(), w.ends[p : p + size].tolist())])
                if (a, text) not in seen:
                    same = [k for k in range(a, b) if self.words(int(place[k]), size) == text]
                    seen[a, text] = bool(same), {self.names[who[k]] for k in same if who[k] >= 0}
                hit, names = seen[a, text]
                if hit:
                    begin.append(p)
                    end.append(p + size)
                    ids[int(np.searchsorted(w.first, p, "right")) - 1].update(names)
        return covered(total, np.array(begin, np.int64), np.array(end, np.int64)), ids


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark in blocks of at most `block_bytes` of text (one longer item is a block of its own), one at a time on the driver."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    block, size, n = [], 0, 0
    for r in rows.toLocalIterator():
        size += len(r.t.encode())
        if block and size > block_bytes:
            yield block
            block, size, n = [], len(r.t.encode()), n + 1
        block.append((r.i, r.t))
    if block or not n:
        yield block


_KIND = "struct<n_words:bigint,hits:array<struct<a:int,b:int>>,items:array<string>>"


def _matcher(block: list[tuple[str, str]], n: int):
    index: list[BenchmarkIndex] = []

    @F.arrow_udf(_KIND)
    def hits(texts: pa.Array) -> pa.Array:
        if not index:
            index.append(BenchmarkIndex(block, n))
        words, spans, items = [], [], []
        for i, j, w in slices(texts, _ALNUM, lower=True):
            flags, ids = index[0].match(w)
            words.extend(w.counts.tolist())
            items.extend(sorted(x) for x in ids)
            some = per_doc(flags, w.first)
            for k in range(j - i):
                if not some[k]:
                    spans.append([])
                    continue
                a, b = w.first[k], w.first[k + 1]
                d = np.diff(flags[a:b].astype(np.int8), prepend=0, append=0)
                spans.append([{"a": int(x), "b": int(y)} for x, y in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))])
        kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(spans, kind[1].type), pa.array(items, kind[2].type)], fields=list(kind))

    return hits


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", n: int = 13, block_bytes: int = 16 << 20) -> tuple[DataFrame, str]:
    """`docs` with a column struct(n_words, hits, items): hit word ranges [a, b) and ids of occurring items.

    Returns the frame and the name of that column, which no column of `docs` has.
    """
    name = fresh(docs, "contamination")
    found: Column | None = None
    for number, block in enumerate(_blocks(benchmark, item_col, bench_text_col, block_bytes)):
        if number and number % PASS_BLOCKS == 0:
            out = saved(out, "matched")
        c = _matcher(block, n)(F.col(text_col))
        if found is None:
            out, found = docs.withColumn(name, c), F.col(name)
        else:
            more = fresh(out, "more")
            out = out.withColumn(more, c)
            m = F.col(more)
            out = out.withColumn(name, F.struct(F.col(name).n_words.alias("n_words"), F.concat(F.col(name).hits, m.hits).alias("hits"), F.array_union(F.col(name)["items"], m["items"]).alias("items"))).drop(more)
    return out, name


def n_hit(c: Column) -> Column:
    """How many words the ranges cover; ranges of different blocks may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e"))
    step = lambda s, r: F.struct((s.n + F.greatest(F.lit(0), r.b - F.greatest(r.a, s.e))).cast("long").alias("n"), F.greatest(s.e, r.b).alias("e"))
    return F.aggregate(F.array_sort(c.hits), start, step, lambda s: s.n)


def contaminated(c: Column, share: int = 20) -> Column:
    """The rule: some word is hit, and at least one in `share` of the words."""
    return (n_hit(c) > 0) & (n_hit(c) * share >= c.n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", share: int = 20, **options) -> DataFrame:
    """`docs` without contaminated documents (remove="documents") or, with remove="spans", all documents
    with each hit span cut out of the text; a cut removes the bytes from its first to its last word."""
    found, name = match_benchmark(docs, benchmark, text_col=text_col, **options)
    if remove == "documents":
        return found.filter(~contaminated(F.col(name), share)).drop(name)
    cut = found.withColumn(text_col, F.when(F.size(F.col(name).hits) > 0, _cut(F.col(text_col), F.array_sort(F.col(name).hits))).otherwise(F.col(text_col)))
    return cut.drop(name)


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out, ranges = [], spans.to_pylist()
    for i, j, w in slices(texts, _ALNUM):
        for k in range(j - i):
            at, end = int(w.offs[k]), int(w.offs[k + 1])
            parts = []
            for r in ranges[i + k] or ():
                s, e = int(w.starts[w.first[k] + r["a"]]), int(w.ends[w.first[k] + r["b"] - 1])
                if e > at:
                    parts.append(w.data[at : max(at, s)].tobytes())
                    at = e
            parts.append(w.data[at:end].tobytes())
            out.append(b"".join(parts).decode())
    valid = texts.is_valid().to_pylist()
    return pa.array([t if v else None for t, v in zip(out, valid)], pa.string())
