"""Shared pieces: collision-free column names, scratch tables and vectorised word scanning.

Word scanning works on the bytes of an Arrow string array in slices of a few MB, so memory does not
follow the batch. All hashes are polynomial sums modulo 2**64 over random tables, finished by a mixer;
they depend on content alone and agree between workers, machines and Python versions.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_SEGMENT = 1 << 19

SPACES = (0x20, *range(0x09, 0x0E))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that Python workers hold, whatever the length of texts; a lower setting is left alone.

    A worker holds its batch, a copy and its result at once, and an executor has a worker for each core.
    """
    jvm = spark._jvm.org.apache.spark.network.util.JavaUtils
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if jvm.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, f"{most}b")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder; a local one only where none is set and the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = given.get() if given.isDefined() else tempfile.mkdtemp(prefix="helixframe-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


HEAVY = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """`rows` joined with the one row that its `key` has in `groups` (a stored table); how="left" keeps keys without one.

    The `HEAVY` largest groups come by broadcast, so none that meets in one task has more than 1 / `HEAVY` of all rows.
    """
    heavy = F.broadcast(groups.orderBy(F.desc(size), key).limit(HEAVY))
    rest = groups.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(rest, key, how))


def word_table(kind: str) -> np.ndarray:
    """256 flags: 'space' counts all bytes but ASCII white space, 'alnum' digits, a-z, A-Z and all non-ASCII."""
    t = np.ones(256, bool)
    if kind == "space":
        t[list(SPACES)] = False
    else:
        t[:0x80] = False
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            t[a:b] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inv)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_rng = np.random.Generator(np.random.Philox(20240607))
_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64)
_byte_powers = _Powers(int(_rng.integers(1 << 60, 1 << 63)) | 1)
_SEQ = [_Powers(int(_rng.integers(1 << 60, 1 << 63)) | 1) for _ in range(2)]
_BYTE2 = _rng.integers(1, 1 << 64, 256, np.uint64)
_SALT = [np.uint64(int(x)) for x in _rng.integers(1, 1 << 63, 2)]


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, int64 offsets of n + 1, null flags) of a string or binary array; null texts are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    null = np.asarray(arr.is_null()) if arr.null_count else np.zeros(n, bool)
    if arr.null_count:
        arr = arr.fill_null("" if "string" in str(arr.type) else b"")
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs, null


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, proofs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, independent second ones) of ascending byte ranges; made piece by piece, so a long text needs little extra."""
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + proofs)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT)))
        at = starts[i]
        part = data[at : ends[j - 1]]
        up, down = _byte_powers.get(len(part) + 1)
        s, e = starts[i:j] - at, ends[i:j] - at
        for h, values in zip(out, (_BYTE, _BYTE2)):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * up[: len(part)], out=total[1:])
            h[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _SALT[0])
        i = j
    return out[0], out[-1]


class Words:
    """The words of some whole documents that lie side by side in `data`.

    starts, ends: byte positions of each word; first: index of each document's first word, n + 1 long.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.data, self.offs = data, offs
        on = table[data]
        before = np.empty_like(on)
        if len(on):
            before[0] = False
            before[1:] = on[:-1]
        cut = offs[(offs > 0) & (offs < len(data))]
        before[cut] = False
        self.starts = np.flatnonzero(on & ~before)
        after = np.empty_like(on)
        if len(on):
            after[-1] = False
            after[:-1] = on[1:]
        after[cut - 1] = False
        self.ends = np.flatnonzero(on & ~after) + 1
        self.on = on
        self.first = np.searchsorted(self.starts, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return byte_hashes(self.data, self.starts, self.ends, proofs=False)[0]

    def text(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """A document's words, those that `keep` flags if given, joined by one space."""
        a, b, at = self.first[doc], self.first[doc + 1], self.offs[doc]
        raw = self.data[at : self.offs[doc + 1]].tobytes()
        starts, ends = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            starts, ends = starts[keep], ends[keep]
        return b" ".join([raw[s:e] for s, e in zip((starts - at).tolist(), (ends - at).tolist())])


class Sequences:
    """Hashes of runs of words: of(a, b) hashes words a to b - 1, the same wherever that sequence stands."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        up, self.down = _SEQ[which].get(len(hashes) + 1)
        h = hashes if which == 0 else mix(hashes ^ _SALT[1])
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64) * _SALT[0])


def starts_of(first: np.ndarray, n: int) -> np.ndarray:
    """The indexes of words at which a run of n words of one document starts."""
    total = int(first[-1])
    if total == 0:
        return np.zeros(0, np.int64)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return np.flatnonzero(room >= n)


def covered(total: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the `total` words that lie in any [start, end)."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags each document has."""
    t = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=t[1:])
    return t[first[1:]] - t[first[:-1]]


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give memory that this process no longer uses back to the system. Workers outlive stages, and what allocators keep of one would lie beside the next one's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(arr: pa.Array, table: np.ndarray, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for consecutive runs of rows of about SLICE_BYTES; a longer text is a run of its own."""
    raw, offs, _ = flat(arr)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1)
        data = raw[offs[i] : offs[j]]
        yield i, j, Words(LOWER[data] if lower else data, offs[i : j + 1] - offs[i], table)
        i = j
    release()


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
