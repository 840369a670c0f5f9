"""Reads by ordinal through the index: byte ranges, cuts inside records, line ends, gzip."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from helixframe.sources import fasta, indexed_fasta


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fasta")
    reads = [(f"r{i} of {i}", "".join("acgtMH"[(i * j) % 6] for j in range(i % 37))) for i in range(400)]
    for name, width, end in (("Healthy_1_x", 10, "\n"), ("Colo_2_y", 7, "\r\n")):
        text = "".join(f">{n}{end}" + "".join(s[k : k + width] + end for k in range(0, len(s), width)) for n, s in reads)
        (d / f"{name}.fa").write_bytes(text.encode())
    (d / "Healthy_3_z.fa.gz").write_bytes(gzip.compress("".join(f">{n}\n{s}\n" for n, s in reads[:50]).encode()))
    return d


@pytest.fixture(scope="module")
def index(spark, folder, tmp_path_factory):
    return indexed_fasta.build_index(spark, f"{folder}/*", str(tmp_path_factory.mktemp("index") / "i"), range_bytes=500, rows_a_file=64)


def test_whole_table_equals_the_scanning_reader(spark, folder, index):
    rows = indexed_fasta.read_indexed(spark, index).select("patient", "read_idx", "name", "seq").collect()
    want = fasta.read_fasta(spark, f"{folder}/*.fa").collect() + [r for r in fasta.read_fasta(spark, f"{folder}/*.gz").collect()]
    assert sorted(map(tuple, rows)) == sorted(("Healthy_3" if r.patient.startswith("Healthy_3") else r.patient, r.read_idx, r.name, r.seq) for r in want)


def test_ordinals_read_only_their_ranges(spark, index, monkeypatch):
    taken = []
    real = indexed_fasta._open

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            out = self.f.read(n)
            taken.append(len(out))
            return out

    monkeypatch.setattr(indexed_fasta, "_open", lambda uri: Counted(real(uri)))
    reader = indexed_fasta.IndexedFastaReader(index, 0)
    wanted = [3, 5, 36, 100, 101, 202, 250, 311, 399, 7000]
    kept = list(reader.pushFilters([EqualTo(("patient",), "Healthy_1"), In(("read_idx",), tuple(wanted)), StringContains(("name",), "r")]))
    assert [type(f) for f in kept] == [StringContains]
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["read_idx"] for r in rows] == wanted[:-1]
    sizes = {r.read_idx: r.bytes for r in spark.read.parquet(index).filter("patient = 'Healthy_1'").collect()}
    assert sum(taken) == sum(sizes[i] for i in wanted[:-1])
    everything = indexed_fasta.IndexedFastaReader(index, 0)
    assert len(parts) < len(everything.partitions())
    none = indexed_fasta.IndexedFastaReader(index, 0)
    list(none.pushFilters([GreaterThan(("read_idx",), 10_000)]))
    assert none.partitions() == []


def test_filters_through_spark(spark, index):
    df = indexed_fasta.read_indexed(spark, index)
    got = df.filter(F.col("read_idx").isin([4, 9, 37]) & (F.col("patient") != "Colo_2")).select("patient", "read_idx", "seq").collect()
    assert sorted((r.patient, r.read_idx) for r in got) == [(p, i) for p in ("Healthy_1", "Healthy_3") for i in (4, 9)]  # the 37th has no letters
    assert all(r.seq == "".join("ACGTMH"[(r.read_idx * j) % 6] for j in range(r.read_idx % 37)) for r in got)


def test_ranges_and_missing_files(spark, tmp_path):
    assert indexed_fasta.merged([(0, 5), (5, 9), (12, 14), (30, 31)], 3) == [(0, 14), (30, 31)]
    with pytest.raises(FileNotFoundError):
        indexed_fasta.build_index(spark, f"{tmp_path}/none*", f"{tmp_path}/i")
