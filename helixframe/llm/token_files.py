"""Token-id files: Parquet list columns in document order, with dictionary-coded ids, fixed row groups and page indexes.

The layout serves selective reads: `doc_id`, `row` and `n_tokens` can be read without the ids; small pages with
column indexes let a filter on `doc_id` skip most of a file; ids are dictionary-coded (16 bits each for a vocabulary
of 50k) and fall back to delta coding where a dictionary grows too large.

Documents stand in ascending id order (null first; equal ids by hash of text, then text). A null text encodes as an empty
one; each document ends with `end_id`. Equal rows stay separate documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

from .common import byte_hashes, flat, release  # noqa: E402

MAX_PIECES, SLICE_BYTES = 1_000_000, 2 << 20
_encoders: dict[str, Encoder] = {}

#: The planner gives about Long.MaxValue for tables whose size it cannot know.
UNKNOWN_SIZE = 1 << 62
#: ASCII white space, before which a piece may begin.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes after which it may not: white space, separators that libraries disagree on.
_OPEN = _WHITE.copy()
_OPEN[0x1C:0x20] = True
#: The other white space of Unicode, in UTF-8.
_WIDE = [bytes.fromhex(x) for x in ("c285", "c2a0", "e19a80", *(f"e280{x:02x}" for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), "e2819f", "e38080")]


def piece_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the pieces of some texts, flags of those that begin with white space after safe text).

    A piece begins with a text, or with ASCII white space after a character that is none: no match of the
    byte-level split spans such a place, so a text's ids are those of its pieces one after another.
    """
    shut = ~_OPEN[data]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        for w in _WIDE if len(at) else ():
            if w[0] == lead:
                ends = at[at + len(w) <= len(data)]
                for i, x in enumerate(w[1:], 1):
                    ends = ends[data[ends + i] == x]
                shut[ends + len(w) - 1] = False
    cut = np.zeros(len(data), bool)
    if len(data):
        cut[1:] = _WHITE[data[1:]] & shut[:-1]
    own = offs[:-1][offs[:-1] < offs[1:]]
    cut[own] = False
    begins = cut.copy()
    begins[own] = True
    starts = np.flatnonzero(begins)
    return starts, cut[starts]


class Encoder:
    """Token ids of whole texts by the library, each distinct piece encoded once while the table has room.

    The table is compact and bounded: hashes, their proofs, and places of ids in one array. New pieces that begin
    with white space and end without are encoded side by side as one text, which the library's own split cuts where
    they meet; the ids are dealt back by the number of bytes that each token stands for.
    """

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        self.tokenizer, self.max_pieces = Tokenizer.from_file(path), max_pieces
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(1 + max(vocabulary.values()), np.int64)
        for token, i in vocabulary.items():  # one character a byte, but for added tokens
            self.bytes_of[i] = len(added[i].encode()) if i in added else len(token)
        self._clear()

    def _clear(self) -> None:
        self.keys = self.proofs = np.zeros(0, np.uint64)
        self.begin = self.size = np.zeros(0, np.int64)
        self.ids, self.used, self.seen, self.missed = np.zeros(1 << 16, np.int32), 0, 0, 0

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many each has)."""
        ids_of, sizes = [], np.zeros(len(starts), np.int64)
        s, e = starts.tolist(), ends.tolist()
        alone, some = np.flatnonzero(~joins), np.flatnonzero(joins)
        for x in self._library([raw[s[k] : e[k]].decode() for k in alone.tolist()]):
            ids_of.append(x)
        sizes[alone] = [len(x) for x in ids_of]
        for i in range(0, len(some), 1 << 15):
            part = some[i : i + (1 << 15)]
            ids = self._library([b"".join([raw[s[k] : e[k]] for k in part.tolist()]).decode()])[0]
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(ends[part] - starts[part]), "left") + 1
            sizes[part] = np.diff(last, prepend=0)
            ids_of.append(ids)
        order = np.concatenate([alone, some])
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(ids_of) if ids_of else np.zeros(0, np.int32), begin, sizes

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some texts side by side, how many each has)."""
        starts, joins = piece_starts(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        shut = ~_OPEN[data[ends - 1]] & (data[ends - 1] < 0x80)
        hashes, proofs = byte_hashes(data, starts, ends)
        u, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.keys, u), max(len(self.keys) - 1, 0))
        known = (self.keys[k] == u) & (self.proofs[k] == proofs[first]) if len(self.keys) else np.zeros(len(u), bool)
        twin = proofs != proofs[first][inverse]  # equal hashes of different pieces: encoded apart
        fresh = np.flatnonzero(~known)
        at = first[fresh]
        raw = data.tobytes()
        ids, places, sizes = self._new(raw, starts[at], ends[at], joins[at] & shut[at])
        begin, size = np.empty(len(u), np.int64), np.empty(len(u), np.int64)
        begin[known], size[known] = self.begin[k[known]], self.size[k[known]]
        begin[fresh], size[fresh] = self.used + places, sizes
        pool = self._room(len(ids))
        pool[self.used : self.used + len(ids)] = ids
        n = size[inverse]
        if twin.any():
            n[twin] = 0
        total = int(n.sum())
        place = np.repeat(begin[inverse] - (np.cumsum(n) - n), n) + np.arange(total)
        out = pool[place]
        for t in np.flatnonzero(twin).tolist()[::-1]:
            own = self._library([raw[starts[t] : ends[t]].decode()])[0]
            out, n[t] = np.insert(out, int(n[:t].sum()), own), len(own)
        self._remember(u[fresh], proofs[at], begin[fresh], sizes, len(ids), len(starts))
        total_of = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total_of[1:])
        piece = np.searchsorted(starts, offs)
        return out, np.diff(total_of[piece])

    def _room(self, more: int) -> np.ndarray:
        if self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(more, len(self.ids)), np.int32)])
        return self.ids

    def _remember(self, keys: np.ndarray, proofs: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int, seen: int) -> None:
        self.seen, self.missed = self.seen + seen, self.missed + len(keys)
        if self.seen > 1_000_000:  # a table full of another language's pieces serves nobody
            if 3 * self.missed > self.seen:
                self._clear()
                return
            self.seen = self.missed = 0
        if len(self.keys) + len(keys) > self.max_pieces:
            return
        self.used += n
        new = ~np.isin(keys, self.keys, assume_unique=True)
        keys, proofs, begin, size = keys[new], proofs[new], begin[new], size[new]
        place = np.searchsorted(self.keys, keys)
        self.keys, self.proofs, self.begin, self.size = np.insert(self.keys, place, keys), np.insert(self.proofs, place, proofs), np.insert(self.begin, place, begin), np.insert(self.size, place, size)


def encode_slices(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, pa.Array]]:
    """(from, to, list<int32> of ids with `end_id` last) for runs of rows of about SLICE_BYTES."""
    enc, (raw, offs, _) = Encoder.load(path), flat(texts)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1)
        ids, size = enc.encode(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        ends = np.zeros(j - i + 1, np.int32)
        np.cumsum(size + 1, out=ends[1:])
        yield i, j, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.insert(ids, np.cumsum(size), end_id)))
        i = j
    release()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables behind `df`, as the planner knows them before it reads; one of unknown size counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_SIZE)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, files: int | None = None, file_bytes: int = 256 << 20, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> None:
    """Encode every text and write (id, row, n_tokens, tokens) to `out`, files and rows in ascending id order.

    `row` numbers rows in that order: the file's place in the upper bits, the place in the file below. Unless `files` is given,
    there is one for each shuffle partition, or for each `file_bytes` of the stored input where these are more.
    """
    spark = docs.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // file_bytes))

    def work(batches):
        for b in batches:
            for i, j, tokens in encode_slices(b.column(2), tokenizer, end_id):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(np.diff(tokens.offsets).astype(np.int64)), tokens], [id_col, "row", "n_tokens", "tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange(files, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    done = placed.select("id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(work, f"`{id_col}` {kind}, row bigint, n_tokens bigint, tokens array<int>")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0", "parquet.column.index.access": "true"}
    done.write.options(**{k: str(v) for k, v in options.items()}).option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files as a table; give columns to read metadata without ids."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


@F.arrow_udf(T.LongType())
def crc32_of(tokens: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    offs = np.asarray(tokens.offsets)
    flat = np.asarray(tokens.values).astype("<i4", copy=False)
    raw = memoryview(flat.tobytes())
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.int64())


def token_digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of written files; `start` counts the ids of all documents before.

    The prefix sum takes two levels: file totals (a row a file), then a running sum inside each file.
    """
    rows = read_tokens(spark, path).select(id_col, "row", F.shiftright("row", 33).alias("file"), "n_tokens", crc32_of("tokens").alias("ids_crc32"))
    totals = read_tokens(spark, path, [id_col, "row", "n_tokens"]).groupBy(F.shiftright("row", 33).alias("file")).agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").select(id_col, (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
