"""FASTA files behind an index of byte ranges: single reads by ordinal without a scan, and scans cut wherever the index is.

`build_index` reads the files once, range by range in parallel, and writes a Parquet table sorted by file and ordinal. The data source
"indexed_fasta" makes a partition of each file of that table; filters on patient, file and read_idx are pushed down, so partitions and
rows that can't match are left out, and only the byte ranges of wanted reads are read. A gzip file has no ranges: its index holds
places in the unpacked stream, which is read up to the last wanted one.

Ordinals, names and letters are those of `fasta.read_fasta`: upper case, without line ends; records with neither name nor letters have no
ordinal, those without letters are left out.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .fasta import patient_of

RANGE_BYTES, ROWS_A_FILE = 64 << 20, 100_000
SCHEMA = "patient string, file string, read_idx bigint, name string, seq string"


def _open(uri: str):
    """A seekable file of unpacked bytes at any place that Arrow can open."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    f = fs.open_input_file(path)
    return gzip.open(f) if uri.endswith(".gz") else f


def _lines(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, line with its end) from a line's start on."""
    rest, start = b"", at
    f.seek(at)
    while block := f.read(1 << 20):
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        for line in lines:
            yield start, line + b"\n"
            start += len(line) + 1
    if rest:
        yield start, rest


def records(uri: str, start: int, end: int | None) -> Iterator[tuple[str, int, int, int]]:
    """(name, place of the letters, their bytes with line ends, letters) of records that begin in [start, end)."""
    with _open(uri) as f:
        if start:
            first = next(_lines(f, start - 1), None)
            if first is None:
                return
            start = first[0] + len(first[1])
        name, at, size, letters = None, 0, 0, 0
        for place, line in _lines(f, start):
            if line.startswith(b">"):
                if name is not None:
                    yield name, at, size, letters
                    name = None
                if end is not None and place >= end:
                    return
                name, at, size, letters = line[1:].strip(b"\r\n").decode(), place + len(line), 0, 0
            elif name is not None:
                size += len(line)
                letters += len(line.translate(None, b"\r\n"))
        if name is not None:
            yield name, at, size, letters


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that a path or pattern names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(p) or ():
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else (status,):
            if s.isFile() and s.getPath().getName()[0] not in "._":
                out.append((s.getPath().toString(), s.getLen()))
    return sorted(out)


def build_index(spark: SparkSession, path: str, out: str, range_bytes: int = RANGE_BYTES, rows_a_file: int = ROWS_A_FILE) -> str:
    """Write (patient, file, read_idx, name, offset, bytes, length) of every record to `out`; returns it."""
    plan = []
    for uri, size in _files(spark, path):
        step = size if uri.endswith(".gz") else range_bytes
        plan += [(uri, a, None if a + step >= size else a + step) for a in range(0, max(size, 1), max(step, 1))]
    if not plan:
        raise FileNotFoundError(path)

    def scan(batches):
        for b in batches:
            for uri, a, e in zip(*(c.to_pylist() for c in b.columns)):
                n, rows = 0, []
                for name, at, size, letters in records(uri, a, e):
                    if name.strip() or letters:
                        rows.append((uri, a, n, name, at, size, letters))
                        n += 1
                    if len(rows) == 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    names = ["file", "start", "n", "name", "offset", "bytes", "length"]
    ranges = spark.createDataFrame(plan, "file string, start bigint, end bigint").repartition(len(plan), "file", "start")
    found = ranges.mapInArrow(scan, "file string, start bigint, n bigint, name string, offset bigint, bytes bigint, length bigint")
    found.write.mode("overwrite").parquet(f"{out}_parts")
    found = spark.read.parquet(f"{out}_parts")
    sizes = found.groupBy("file", "start").agg(F.count("*").alias("size"))
    before = sizes.select("file", "start", (F.sum("size").over(Window.partitionBy("file").orderBy("start")) - F.col("size")).alias("before"))
    rows = found.join(before, ["file", "start"]).select(patient_of(F.regexp_replace("file", r"\.gz$", "")).alias("patient"), "file", (F.col("before") + F.col("n")).alias("read_idx"), "name", "offset", "bytes", "length")
    rows.repartitionByRange("file", "read_idx").sortWithinPartitions("file", "read_idx").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(out)
    return out


def merged(ranges: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Ascending (start, end) with those no further apart than `gap` read as one."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a - out[-1][1] <= gap:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


@dataclass
class Part(InputPartition):
    path: str


class IndexedFastaReader(DataSourceReader):
    def __init__(self, index: str, gap: int):
        self.index, self.gap, self.where = index, gap, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of patient, file and read_idx with values; Spark keeps the rest."""
        make = {EqualTo: lambda c, v: c == v, In: lambda c, v: c.isin(list(v)), GreaterThan: lambda c, v: c > v, GreaterThanOrEqual: lambda c, v: c >= v, LessThan: lambda c, v: c < v, LessThanOrEqual: lambda c, v: c <= v}
        for f in filters:
            if type(f) in make and f.attribute in (("patient",), ("file",), ("read_idx",)):
                one = make[type(f)](ds.field(f.attribute[0]), f.value)
                self.where = one if self.where is None else self.where & one
            else:
                yield f

    def _dataset(self, paths: list[str] | None = None) -> ds.Dataset:
        fs, path = pyarrow.fs.FileSystem.from_uri(self.index) if "://" in self.index else (pyarrow.fs.LocalFileSystem(), self.index)
        return ds.dataset(path if paths is None else paths, filesystem=fs, format="parquet")

    def partitions(self) -> list[Part]:
        """The index's files whose statistics allow a match."""
        out = []
        for fragment in self._dataset().get_fragments(self.where):
            if self.where is None or any(len(x.row_groups) for x in [fragment.subset(self.where)]):
                out.append(Part(fragment.path))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows = self._dataset([partition.path]).to_table(filter=self.where).sort_by([("file", "ascending"), ("offset", "ascending")])
        rows = rows.filter(pa.compute.greater(rows["length"], 0))
        for uri in rows["file"].unique().to_pylist():
            own = rows.filter(pa.compute.equal(rows["file"], uri))
            offset, size = own["offset"].to_pylist(), own["bytes"].to_pylist()
            with _open(uri) as f:
                at = 0
                for a, b in merged([(o, o + n) for o, n in zip(offset, size)], self.gap):
                    f.seek(a)
                    raw, seqs, first = f.read(b - a), [], at
                    while at < len(offset) and offset[at] + size[at] <= b:
                        seqs.append(raw[offset[at] - a : offset[at] + size[at] - a].translate(None, b"\r\n").decode().upper())
                        at += 1
                    part = own.slice(first, at - first)
                    yield pa.RecordBatch.from_arrays([part[c].combine_chunks() for c in ("patient", "file", "read_idx", "name")] + [pa.array(seqs, pa.string())], ["patient", "file", "read_idx", "name", "seq"])


class IndexedFasta(DataSource):
    """options: `index` (a folder of `build_index`), `gap` (bytes between reads that are read along, 4096)."""

    @classmethod
    def name(cls) -> str:
        return "indexed_fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IndexedFastaReader:
        return IndexedFastaReader(self.options["index"], int(self.options.get("gap", 4096)))


def read_indexed(spark: SparkSession, index: str, gap: int = 4096) -> DataFrame:
    """(patient, file, read_idx, name, seq); filters on the first three reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedFasta)
    return spark.read.format("indexed_fasta").option("index", index).option("gap", gap).load()
