"""Ranked lexical search: the best documents of every item of a query table, by sort-based accumulation over all documents.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A first pass reads every whole text once
and stores, for each document, the query terms that it holds with their counts; statistics (documents, terms, documents that hold a
term) are sums over that table. A second pass turns counts into integer impacts, concatenates the (item, document, impact)
triples of a stretch of documents, sorts their packed keys by radix and sums impacts by `reduceat`. Each task keeps
the best k of every item in heaps, so it returns at most k rows an item; those meet by item, in two steps.

Items are taken in blocks of bounded text (a parameter), whose vocabulary is broadcast; each block is a pass over the documents.
Term hits are looked up by hash and compared byte by byte. A null or empty text has no terms: such a document is not
counted and never found, such an item finds nothing. Equal scores stand in ascending id order, a null id first; repeated documents and
repeated items are rows of their own. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, byte_hashes, saved, slices, word_table

_ALNUM = word_table("alnum")
_TABLE_BITS = 16
#: Triples that are sorted at once; the documents of a batch are cut into stretches of about so many.
TRIPLES = 1 << 20


@dataclass
class Index:
    """The vocabulary of some items, in order of the terms' hashes, and each term's items.

    keys, at, size: hash, place in `data` and bytes of each term; first: where a term's entries begin in `items` (the items'
    places in the block) and `times` (how often the item holds it), one longer than keys.
    """

    keys: np.ndarray
    at: np.ndarray
    size: np.ndarray
    data: np.ndarray
    first: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Index:
        holders: dict[bytes, Counter] = {}
        for i, j, w in slices(pa.array(texts, pa.large_string()), _ALNUM, lower=True):
            raw, doc = w.data.tobytes(), w.doc.tolist()
            for s, e, d in zip(w.starts.tolist(), w.ends.tolist(), doc):
                holders.setdefault(raw[s:e], Counter())[i + d] += 1
        terms = list(holders)
        size = np.array([len(t) for t in terms], np.int64)
        at = np.cumsum(size) - size
        data = np.frombuffer(b"".join(terms), np.uint8)
        keys = byte_hashes(data, at, at + size, proofs=False)[0]
        order = np.argsort(keys, kind="stable")
        held = [holders[terms[k]] for k in order.tolist()]
        first = np.zeros(len(held) + 1, np.int64)
        np.cumsum([len(h) for h in held], out=first[1:])
        items, times = (np.array([x for h in held for x in f(h)], np.int64) for f in (dict.keys, dict.values))
        return cls(keys[order], at[order], size[order], data, first, items, times)

    def __post_init__(self):
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.twins = int(np.unique(self.keys, return_counts=True)[1].max()) if len(self.keys) else 0

    def lookup(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words that are terms, which term each is)."""
        h = w.hashes()
        some = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[some])
        found, which = [], []
        for twin in range(self.twins):  # more than one round only where terms share a hash
            k = at + twin
            ok = k < len(self.keys)
            word, k = some[ok], k[ok]
            ok = (self.keys[k] == h[word]) & (self.size[k] == w.ends[word] - w.starts[word])
            word, k = word[ok], k[ok]
            same = self._same(w, word, k)
            found.append(word[same])
            which.append(k[same])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(which)

    def _same(self, w: Words, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros(0, bool)
        n = self.size[k]
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum()))
        equal = w.data[np.repeat(w.starts[word] - begin, n) + step] == self.data[np.repeat(self.at[k] - begin, n) + step]
        return np.logical_and.reduceat(equal, begin)

    def postings(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, terms, counts) of some documents, ascending."""
        word, term = self.lookup(w)
        doc = np.searchsorted(w.first, word, "right") - 1
        key, count = np.unique(doc * max(len(self.keys), 1) + term, return_counts=True)
        return key // max(len(self.keys), 1), key % max(len(self.keys), 1), count


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 64-bit keys: counting sorts by 16-bit digits, lowest first; digits that are all equal are skipped."""
    order = np.arange(len(keys))
    for shift in range(0, 64, 16):
        digit = (keys >> np.uint64(shift)).astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


@dataclass
class Scoring:
    """Integer scoring: `weights` by term, `documents` and `terms` of the collection; the length share `b` is in hundredths, `k1` in tenths."""

    weights: np.ndarray
    documents: int
    terms: int
    b: int = 25
    k1: int = 12

    @staticmethod
    def weight(documents: int, holders: np.ndarray) -> np.ndarray:
        return np.floor(1000 * np.log((2 * documents + 2) / (2 * holders + 1))).astype(np.int64)

    def impacts(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 100 - self.b + self.b * length * self.documents // self.terms
        return self.weights[term] * (1_000_000_000 * count // (1000 * count + self.k1 * m))


def accumulate(index: Index, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(items, documents, scores) of stretches of documents, items ascending in each; `doc` is ascending."""
    keep = impact > 0
    doc, term, impact = doc[keep], term[keep], impact[keep]
    n = index.first[term + 1] - index.first[term]
    ends, i = np.cumsum(n), 0
    while i < len(doc):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + TRIPLES)))
        j = int(np.searchsorted(doc, doc[j - 1], "right"))  # whole documents
        size = n[i:j]
        begin = np.cumsum(size) - size
        entry = np.repeat(index.first[term[i:j]] - begin, size) + np.arange(int(size.sum()))
        key = index.items[entry].astype(np.uint64) << np.uint64(32) | np.repeat(doc[i:j], size).astype(np.uint64)
        value = np.repeat(impact[i:j], size) * index.times[entry]
        order = radix_order(key)
        key = key[order]
        cut = np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1)))
        yield (key[cut] >> np.uint64(32)).astype(np.int64), (key[cut] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.add.reduceat(value[order], cut)
        i = j


class Best:
    """The k best documents of each item so far: highest score, then lowest id."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}
        self.least = np.ones(0, np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if not len(item):
            return
        if item[-1] >= len(self.least):
            self.least = np.append(self.least, np.ones(int(item[-1]) + 1 - len(self.least), np.int64))
        some = np.flatnonzero(score >= self.least[item])
        first = np.flatnonzero(np.diff(item[some], prepend=-1))
        for part in np.split(some, first[1:]) if len(some) else ():
            if len(part) > 2 * self.k:
                part = part[score[part] >= np.partition(score[part], len(part) - self.k)[len(part) - self.k]]
            x = int(item[part[0]])
            new = [(-s, i is not None, i) for s, i in zip(score[part].tolist(), ids.take(pa.array(doc[part])).to_pylist())]
            best = self.kept[x] = heapq.nsmallest(self.k, self.kept.get(x, []) + new)
            if len(best) == self.k:
                self.least[x] = -best[-1][0]

    def rows(self) -> tuple[list, list, list]:
        flat = [(x, i, -s) for x, best in self.kept.items() for s, _, i in best]
        return tuple([r[c] for r in flat] for c in range(3))


def blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, texts) of items (no, text) in blocks of at most `block_bytes` of text; a longer item is a block of its own."""
    numbers, texts, size = [], [], 0
    for r in items.filter("text <> ''").select("no", "text").toLocalIterator():
        n = len(r.text.encode())
        if numbers and size + n > block_bytes:
            yield numbers, texts
            numbers, texts, size = [], [], 0
        numbers.append(r.no)
        texts.append(r.text)
        size += n
    if numbers:
        yield numbers, texts


def match(docs: DataFrame, index) -> DataFrame:
    """(id, n, terms, counts) of documents (id, text) that have a term: their length and the terms of the broadcast index that they hold."""

    def work(batches):
        for b in batches:
            for i, j, w in slices(b.column(1), _ALNUM, lower=True):
                doc, term, count = index.value.postings(w)
                n = w.counts
                some = np.flatnonzero(n)
                ends = np.append(0, np.searchsorted(doc, some, "right")).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].take(pa.array(some)), pa.array(n[some], pa.int64()), *lists], ["id", "n", "terms", "counts"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(work, f"id {kind}, n bigint, terms array<int>, counts array<int>")


def statistics(matched: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, their terms, documents that hold each query term)."""

    def work(batches):
        held, n, total = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            held += np.bincount(np.asarray(b.column(1).flatten()), minlength=terms)
            n, total = n + b.num_rows, total + int(np.asarray(b.column(0)).sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(held[some], [n, total]))], ["term", "x"])

    sums = matched.select("n", "terms").mapInArrow(work, "term bigint, x bigint").groupBy("term").agg(F.sum("x").alias("x")).toArrow()
    term, x = np.asarray(sums["term"]), np.asarray(sums["x"])
    held = np.zeros(terms, np.int64)
    held[term[term >= 0]] = x[term >= 0]
    return int(x[term == -1].sum()), int(x[term == -2].sum()), held


def top_by(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """`rows` of the k highest scores by keys, with their `rank`."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 20, b: int = 25, k1: int = 12, block_bytes: int = 16 << 20) -> DataFrame:
    """(item, rank, id, score): the k documents of highest score above 0 for each row of `items`."""
    spark = docs.sparkSession
    queries = saved(items.select(F.monotonically_increasing_id().alias("no"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), "items")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = None
    for numbers, block in blocks(queries, block_bytes):
        found = _search_block(spark, texts, np.array(numbers, np.int64), block, kind, k, b, k1)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.limit(0).select(F.lit(0).cast("bigint").alias("no"), "id", F.lit(0).cast("bigint").alias("score"), F.lit(0).alias("rank"))
    return out.join(queries.select("no", "item"), "no").select("item", "rank", "id", "score")


def _search_block(spark, texts: DataFrame, numbers: np.ndarray, block: list[str], kind: str, k: int, b: int, k1: int) -> DataFrame:
    index = spark.sparkContext.broadcast(Index.of(block))
    matched = saved(match(texts, index), "matched")
    documents, terms, held = statistics(matched, len(index.value.keys))
    scoring = spark.sparkContext.broadcast(Scoring(Scoring.weight(documents, held), documents, max(terms, 1), b, k1))

    def work(batches):
        best = Best(k)
        for x in batches:
            count = np.diff(np.asarray(x.column(2).offsets))
            doc = np.repeat(np.arange(len(count)), count)
            term, times = (np.asarray(x.column(c).flatten()).astype(np.int64) for c in (2, 3))
            impact = scoring.value.impacts(term, times, np.asarray(x.column(1))[doc])
            for part in accumulate(index.value, doc, term, impact):
                best.add(*part, x.column(0))
        item, ids, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[np.array(item, np.int64)]), pa.array(ids, id_type), pa.array(score, pa.int64())], ["no", "id", "score"])

    id_type = _arrow_type(matched, "id")
    rows = matched.mapInArrow(work, f"no bigint, id {kind}, score bigint")
    # tasks are many at scale, and each returns up to k rows an item: first by item and group of tasks
    grouped = top_by(rows.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64))), ["no", "group"], k)
    return top_by(grouped.drop("rank", "group"), ["no"], k)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
