"""Best-fit packing of documents' tokens into sequences of a fixed capacity, in bulk-synchronous rounds.

Documents end with a token of their own. Longer ones are cut into full pieces, the first of which may be shorter; a piece of more
than half the capacity opens a sequence, and what its sequence has left is a gap. In each round the pieces without a place and the gaps
are range-sorted together by size. Each range is swept upwards: a gap takes the largest waiting pieces that fit, as many as do. What a range leaves,
waiting pieces and untouched gaps, meets on the driver as runs of equal size, at most one for each size and one more for each range,
where the same sweep settles by rank which of them go together; the rows follow by their places in the ranges. Gaps then shrink
and the next round begins with what is left. Where a piece is larger than all gaps, such pieces get as many empty sequences as
their tokens ask for. Every round places a piece or opens a sequence, so the rounds end.

A null or empty text is its end token alone; repeated documents and ids are packed as rows of their own, also null ids. Very long texts are
encoded and cut whole. Equal sizes stand in order of their numbers. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .token_files import encode_slices

#: Pieces and gaps in a range, of some 20 bytes each.
ROWS = 1 << 16
PIECE, GAP = 0, 1
#: Fixed values of a round's rows: placed pieces, waiting ones, untouched gaps, gaps that took a piece.
PLACED, WAITING, UNTOUCHED, SHRUNK = range(4)
_PLACE = np.int64(1) << np.int64(40)


def cut(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_tokens: bool = False) -> DataFrame:
    """(id, piece, start, length, crc32) of the pieces of every document, with their `tokens` if asked for; crc32 is over little-endian unsigned 32-bit ids."""

    def work(batches):
        for b in batches:
            for i, j, tokens in encode_slices(b.column(1), tokenizer, end_id):
                ends = np.asarray(tokens.offsets).astype(np.int64)
                n = np.diff(ends)
                pieces = (n - 1) // capacity + 1
                number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = np.repeat(n - (pieces - 1) * capacity, pieces)
                start = np.where(number == 0, 0, first + (number - 1) * capacity)
                length = np.where(number == 0, first, capacity)
                at = np.repeat(ends[:-1], pieces) + start
                raw = memoryview(np.asarray(tokens.values).astype("<i4", copy=False).tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist())]
                columns = [b.column(0)[i:j].take(pa.array(np.repeat(np.arange(j - i), pieces))), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_tokens:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]).astype(np.int32)), tokens.values))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "piece", "start", "length", "crc32"] + ["tokens"] * with_tokens
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, piece int, start bigint, length bigint, crc32 bigint" + ", tokens array<int>" * with_tokens)


def sweep(runs: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Match runs (kind, size, range, first place, rows) in ascending order of size, pieces before gaps.

    Gives takes (range and first place of some pieces, how many, how many of them a gap gets, range and first place of the gaps, room of
    those gaps that was in use, size of a piece), runs of waiting pieces (size, range, first place, rows), and all gaps (range, first place, rows, room left, room before).
    """
    waiting: list[list[int]] = []
    takes, gaps = [], []
    for kind, size, part, lo, n in runs:
        if kind == PIECE:
            waiting.append([size, part, lo, n])
            continue
        todo = [(lo, n, size)]
        while todo:
            lo, n, room = todo.pop()
            if not waiting or waiting[-1][0] > room:
                gaps.append((part, lo, n, room, size))
                continue
            top = waiting[-1]
            each = min(room // top[0], top[3])
            some = min(n, top[3] // each)
            top[3] -= each * some
            takes.append((top[1], top[2] + top[3], each * some, each, part, lo, size - room, top[0]))
            if not top[3]:
                waiting.pop()
            if n > some:
                todo.append((lo + some, n - some, room))
            todo.append((lo, some, room - each * top[0]))
    return takes, [tuple(w) for w in waiting], gaps


def _runs(size: np.ndarray, kind: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    first = np.flatnonzero(np.diff(2 * size + kind, prepend=-1))
    return list(zip(kind[first].tolist(), size[first].tolist(), [0] * len(first), first.tolist(), np.diff(first, append=len(size)).tolist()))


def _sweep_range(capacity: int):
    """Sweeps the sorted rows (size, kind, id) of a range and gives (what, part, pos, size, id, sequence, offset)."""

    def work(batches):
        got = [[np.asarray(c) for c in b.columns] for b in batches]
        if not got:
            return
        size, kind, ids = (np.concatenate(x) for x in zip(*got))
        takes, waiting, gaps = sweep(_runs(size, kind))
        part, out = TaskContext.get().partitionId(), []

        def put(what, at, sizes, sequence=None, offset=None):
            none = np.zeros(len(at), np.int64)
            out.append([np.full(len(at), what), np.full(len(at), part), at, sizes, ids[at], none if sequence is None else sequence, none if offset is None else offset])

        for _, lo, n, each, _, gap, used, length in takes:
            i = np.arange(n)
            g = gap + i // each
            put(PLACED, lo + i, np.full(n, length), ids[g], capacity - size[g] + used + i % each * length)
        for _, _, lo, n in waiting:
            put(WAITING, np.arange(lo, lo + n), size[lo : lo + n])
        for _, lo, n, room, before in gaps:
            put(UNTOUCHED if room == before else SHRUNK, np.arange(lo, lo + n), np.full(n, room))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["what", "part", "pos", "size", "id", "sequence", "offset"])

    return work


class _Lookup:
    """Which of some disjoint ranges of places holds a row."""

    def __init__(self, ranges: list[tuple[int, int, int]]):
        """ranges: (part, first place, rows)."""
        lo = np.array([p * int(_PLACE) + a for p, a, _ in ranges], np.int64)
        self.order = np.argsort(lo)
        self.lo = lo[self.order]
        self.n = np.array([n for *_, n in ranges], np.int64)[self.order]

    def __call__(self, part: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that are held, by which range)."""
        if not len(self.lo):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = part * _PLACE + pos
        k = np.searchsorted(self.lo, key, "right") - 1
        held = np.flatnonzero((k >= 0) & (key < self.lo[k] + self.n[k]))
        return held, self.order[k[held]]


@dataclass
class Round:
    """A round's stored rows, and what the sweep over all ranges' leftovers decided."""

    rows: DataFrame
    takes: list[tuple]
    waiting: list[tuple]
    gaps: list[tuple]
    shrunk: list[tuple[int, int]]

    def left(self, least: int) -> DataFrame:
        """(size, kind, id) of the next round: waiting pieces without a gap, and gaps of at least `least`."""
        taken, held = _Lookup([(p, lo, n) for p, lo, n, *_ in self.takes]), _Lookup([g[:3] for g in self.gaps])
        rooms = np.array([g[3] for g in self.gaps], np.int64)

        def work(batches):
            for b in batches:
                what, part, pos, size, ids = (np.asarray(b.column(c)) for c in range(5))
                keep, size = np.ones(len(what), bool), size.copy()
                rows = np.flatnonzero(what == WAITING)
                keep[rows[taken(part[rows], pos[rows])[0]]] = False
                rows = np.flatnonzero(what == UNTOUCHED)
                k, which = held(part[rows], pos[rows])
                size[rows[k]] = rooms[which]
                keep &= (what == WAITING) | (size >= least)
                yield pa.RecordBatch.from_arrays([pa.array(size[keep]), pa.array((what[keep] != WAITING).astype(np.int64)), pa.array(ids[keep])], ["size", "kind", "id"])

        return self.rows.filter(F.col("what") != PLACED).select("what", "part", "pos", "size", "id").mapInArrow(work, "size bigint, kind bigint, id bigint")

    def placed(self, capacity: int) -> DataFrame:
        """(id, sequence, offset) of the pieces placed in this round: inside a range, or by ranks across ranges."""
        inside = self.rows.filter(F.col("what") == PLACED).select("id", "sequence", "offset")
        if not self.takes:
            return inside
        taken = _Lookup([(p, lo, n) for p, lo, n, *_ in self.takes])
        table = np.array([t[1:] for t in self.takes], np.int64)

        def work(batches):
            for b in batches:
                part, pos, ids = (np.asarray(b.column(c)) for c in range(3))
                k, which = taken(part, pos)
                lo, _, each, gpart, gap, used, length = table[which].T
                i = pos[k] - lo
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[k], gpart, gap + i // each, used + i % each * length)], ["id", "part", "pos", "used"])

        pieces = self.rows.filter(F.col("what") == WAITING).select("part", "pos", "id").mapInArrow(work, "id bigint, part bigint, pos bigint, used bigint")
        gaps = self.rows.filter(F.col("what") == UNTOUCHED).select("part", "pos", F.col("id").alias("sequence"), (F.lit(capacity) - F.col("size")).alias("base"))
        return inside.unionByName(pieces.join(gaps, ["part", "pos"]).select("id", "sequence", (F.col("base") + F.col("used")).alias("offset")))


def _round(pool: DataFrame, rows: int, capacity: int) -> Round:
    order = ["size", "kind", "id"]
    ranges = pool.repartitionByRange(-(-rows // ROWS), *order).sortWithinPartitions(*order)
    swept = saved(ranges.select(*order).mapInArrow(_sweep_range(capacity), "what bigint, part bigint, pos bigint, size bigint, id bigint, sequence bigint, offset bigint"), "round")
    runs = swept.filter(F.col("what") != PLACED).groupBy("part", "what", "size").agg(F.min("pos").alias("lo"), F.count("*").alias("n")).toArrow().to_pylist()
    open_runs = sorted((r["part"], r["lo"], r["what"] - WAITING, r["size"], r["n"]) for r in runs if r["what"] != SHRUNK)
    takes, waiting, gaps = sweep([(kind, size, part, lo, n) for part, lo, kind, size, n in open_runs])
    return Round(swept, takes, waiting, gaps, [(r["size"], r["n"]) for r in runs if r["what"] == SHRUNK])


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The rows of `pieces` (a table with an integer `length` from 1 to `capacity`) with `sequence` and `offset`: sequences without gaps inside."""
    if {"sequence", "offset", "uid"} & {c.lower() for c in pieces.columns}:
        raise ValueError("pieces have a column named sequence, offset or uid")
    spark = pieces.sparkSession
    numbered = saved(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    long = 2 * F.col("length") > capacity
    counts = [(r["length"], r["n"]) for r in numbered.groupBy("length").agg(F.count("*").alias("n")).toArrow().to_pylist()]
    waiting = [(s, n) for s, n in counts if 2 * s <= capacity]
    gaps = [(capacity - s, n) for s, n in counts if capacity < 2 * s]
    pool = numbered.select(F.when(long, capacity - F.col("length")).otherwise(F.col("length")).alias("size"), F.when(long, GAP).otherwise(PIECE).cast("bigint").alias("kind"), F.col("uid").alias("id")).filter("size > 0")
    opened, rounds = 0, []
    while waiting:
        least, most = min(s for s, _ in waiting), max((s for s, _ in gaps), default=0)
        gaps = [(s, n) for s, n in gaps if s >= least]
        new = -(-sum(s * n for s, n in waiting if s > most) // capacity)
        if new:
            empty = spark.range(new).select(F.lit(capacity).cast("bigint").alias("size"), F.lit(GAP).cast("bigint").alias("kind"), (-F.col("id") - opened - 1).alias("id"))
            pool, opened = pool.unionByName(empty), opened + new
        rounds.append(_round(pool, sum(n for _, n in waiting) + sum(n for _, n in gaps) + new, capacity))
        last = rounds[-1]
        waiting, gaps = [(s, n) for s, _, _, n in last.waiting], [(room, n) for *_, n, room, _ in last.gaps] + last.shrunk
        pool = last.left(min((s for s, _ in waiting), default=0))
    done = numbered.filter(long).withColumn("sequence", F.col("uid")).withColumn("offset", F.lit(0).cast("bigint"))
    if rounds:
        placed = rounds[0].placed(capacity)
        for r in rounds[1:]:
            placed = placed.unionByName(r.placed(capacity))
        done = done.unionByName(numbered.filter(~long).join(placed.withColumnRenamed("id", "uid"), "uid"))
    return done.drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence, tokens) of packed pieces with tokens."""
    return packed.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("offset", "tokens"))).alias("p")).select("sequence", F.flatten(F.transform("p", lambda x: x.tokens)).alias("tokens"))
