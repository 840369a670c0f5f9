"""Reproducible sampling: order by a keyed digest, then take by rank. No random stream, so splits do not depend on each other."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.statistics import QUANTILES, digest_rank, hash_order, with_keys
from ..storage import saved


def _ranked(df: DataFrame, seed: int, keys: list[str], ident: str) -> DataFrame:
    order = hash_order(seed, *[F.col(k) for k in keys], F.col(ident))
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order, ident)))


def readable(reads: DataFrame) -> DataFrame:
    """Reads that exist, in upper case."""
    return reads.filter("seq IS NOT NULL").withColumn("seq", F.upper("seq"))


def stratified(reads: DataFrame, total: int, n_patients: int, seed: int = 42) -> DataFrame:
    """total // n_patients reads of each patient (the remainder is dropped; fewer where fewer exist), with their read_idx."""
    return _ranked(readable(reads), seed, ["patient"], "read_idx").filter(F.col("rn") <= total // max(n_patients, 1)).drop("rn")


def cohort(reads: DataFrame, roles: dict[str, tuple[list[str], int]], seed: int = 42) -> DataFrame:
    """One table of several stratified samples: roles maps split to (patients, total). Adds the column split."""
    out = None
    for i, (split, (patients, total)) in enumerate(roles.items()):
        part = stratified(reads.filter(F.col("patient").isin(patients)), total, len(patients), seed + i).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def files_info(reads: DataFrame) -> DataFrame:
    """(patient, label, num_sequences)"""
    return reads.groupBy("patient", "label").agg(F.count("*").alias("num_sequences"))


def disjoint_rounds(reads: DataFrame, n_rounds: int, per_round: int, seed: int = 42, excluded: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Each patient's reads dealt into disjoint rounds of `per_round`; `excluded` (patient, read_idx) never take part.

    strict: a patient with too few reads raises; else such patients get as many full rounds as they fill.
    """
    rows = readable(reads)
    if excluded is not None:
        rows = rows.join(excluded.select("patient", "read_idx").distinct(), ["patient", "read_idx"], "left_anti")
    if strict:
        short = rows.groupBy("patient").count().filter(F.col("count") < n_rounds * per_round).select("patient").first()
        if short:
            raise ValueError(f"{short[0]} has too few reads for {n_rounds} rounds of {per_round}")
    available = rows.groupBy("patient").agg(F.least(F.lit(n_rounds), F.floor(F.count("*") / per_round)).alias("full"))
    order = hash_order(seed, F.col("patient"), F.col("read_idx"))
    ranked = with_keys(digest_rank(rows, order, "read_idx", ["patient"]), available, ["patient"])
    return ranked.filter(F.col("rn") <= F.col("full") * per_round).withColumn("round", (F.floor((F.col("rn") - 1) / per_round) + 1).cast("int")).drop("rn", "full")


#: Rows of one key above which what no sample can take is left out before the key's rows meet.
HOT = 65_536


def subsample_scores(scores: DataFrame, sizes: list[int], keys: list[str], repeats: int = 1, seed: int = 42) -> DataFrame:
    """Samples of each size (all scores where fewer) of each key, `repeats` times: adds n_reads and rep.

    A sample holds a key's least digests. Scores are dealt out by key once, whatever the number of samples, and samples are taken of
    a few keys at a time. Of a key of very many scores, pieces are cut first to what some sample may take.
    """
    cells, names = [(n, rep) for n in sizes for rep in range(1, repeats + 1)], scores.columns

    def take(t: pa.Table, key: np.ndarray):
        for n, rep, own in _samples(t, key, cells, seed):
            yield pa.Table.from_arrays([*t.select(names).take(pa.array(own)).columns, pa.array(np.full(len(own), n, np.int32)), pa.array(np.full(len(own), rep, np.int32))], [*names, "n_reads", "rep"])

    schema = T.StructType([*scores.schema.fields, T.StructField("n_reads", T.IntegerType()), T.StructField("rep", T.IntegerType())])
    return _by_key(_cut(_suffixed(scores, keys), keys, cells, seed), keys, [], take, schema)


def sampled_aggregates(scores: DataFrame, sizes: list[int], keys: list[str], repeats: int = 1, seed: int = 42, tops: tuple[int, ...] = (100, 500)) -> DataFrame:
    """(keys, label, n_reads, rep, aggregator, value): the built-in aggregators of `subsample_scores`, made where the samples are taken, so
    that no sample is written out. A sample that is a key's whole rows is the same in every repetition, and is looked at once."""
    cells, quantiles = [(n, rep) for n in sizes for rep in range(1, repeats + 1)], list(QUANTILES.items())
    small = _suffixed(scores.select(*dict.fromkeys([*keys, "label", "read_idx"]), F.col("score").cast("double").alias("score")), keys)

    def take(t: pa.Table, key: np.ndarray):
        group = np.cumsum(_changes(t, ["label"]) | np.concatenate([[True], np.diff(key) != 0])) - 1
        score, some = t["score"].combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False), np.asarray(t["score"].is_valid())
        order, last = np.lexsort((score, group)), None
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for n, rep, own in _samples(t, key, cells, seed):
            if last is None or len(own) != len(last[0]) or not np.array_equal(own, last[0]):
                at = order[np.sort(rank[own[some[own]]])]  # by group and score
                last = own, _values(score[at], group[at], quantiles, tops)
            groups, values = last[1]
            rows = t.select([*keys, "label"]).take(pa.array(np.searchsorted(group, groups)))
            yield pa.Table.from_arrays([*rows.columns, pa.array(np.full(len(groups), n, np.int32)), pa.array(np.full(len(groups), rep, np.int32)), *[pa.array(v) for v in values]], [*keys, "label", "n_reads", "rep", *names])

    names = ["max", "mean", *QUANTILES, *[f"top{k}" for k in tops]]
    fields = [small.schema[c] for c in [*keys, "label"]]
    schema = T.StructType([*fields, T.StructField("n_reads", T.IntegerType()), T.StructField("rep", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    wide = _by_key(_cut(small, keys, cells, seed), keys, ["label"], take, schema)
    return wide.unpivot([*keys, "label", "n_reads", "rep"], names, "aggregator", "value")


def _values(x: np.ndarray, group: np.ndarray, quantiles: list[tuple[str, float]], tops: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(groups, for each aggregator their values) of values in ascending order within ascending groups."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    end = np.append(first, len(x))[1:]
    size, padded = end - first, np.append(x, 0.0)
    mean = lambda k: np.add.reduceat(padded, np.stack([end - np.minimum(k, size), end], 1).ravel())[::2] / np.minimum(k, size) if len(x) else x
    out = [x[end - 1], mean(size)]
    for _, q in quantiles:
        spot = q * (size - 1)
        a, b = x[first + np.floor(spot).astype(np.int64)], x[first + np.ceil(spot).astype(np.int64)]
        out.append(np.where(a == b, a, a + (spot - np.floor(spot)) * (b - a)))
    return group[first], [*out, *[mean(k) for k in tops]]


def _suffixed(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Adds what a row's digest ends in."""
    return scores.withColumn("suffix_", F.concat_ws("|", *[F.col(k).cast("string") for k in [*keys, "read_idx"]]))


def _samples(t: pa.Table, key: np.ndarray, cells: list[tuple[int, int]], seed: int):
    """(n, rep, places in ascending order) of each cell's sample of whole keys, whose rows stand together."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(first, append=len(key))
    whole = np.arange(len(key))
    for n in dict.fromkeys(n for n, _ in cells):
        large = np.repeat(size > n, size)
        some, rest = np.flatnonzero(large), whole[~large]
        suffix = [x.encode() for x in t["suffix_"].take(pa.array(some)).to_pylist()]
        ident = t["read_idx"].take(pa.array(some)).combine_chunks().dictionary_encode() if len(some) else None
        place = np.argsort(np.argsort(np.array(ident.dictionary.to_pylist(), object), kind="stable"))[np.asarray(ident.indices)] if len(some) and not ident.null_count else np.arange(len(some))
        for rep in [r for m, r in cells if m == n]:
            if not len(some):
                yield n, rep, whole
                continue
            start = f"{seed}|{rep}|{n}|".encode()
            digest = np.frombuffer(b"".join([hashlib.md5(start + x).digest() for x in suffix]), ">u8").reshape(-1, 2).astype(np.uint64)
            order = np.lexsort((place, digest[:, 1], digest[:, 0], key[some]))
            began = np.flatnonzero(np.diff(key[some][order], prepend=-1))
            nth = np.arange(len(order)) - np.repeat(began, np.diff(began, append=len(order)))
            yield n, rep, np.sort(np.concatenate([rest, some[order[nth < n]]]))


def _changes(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before in some column (the first does)."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in columns:
        codes = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices
        out[1:] |= np.diff(np.asarray(codes)) != 0
    return out


def _by_key(df: DataFrame, keys: list[str], inside: list[str], take, schema: T.StructType) -> DataFrame:
    """take(rows, key numbers) of whole keys, about a batch of them at a time; `inside` orders a key's rows."""

    def work(batches):
        kept, held = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ends = [tuple(b.column(c)[i].as_py() for c in keys) for i in (0, b.num_rows - 1)]
            if held == ends[0] == ends[1] or not kept:
                kept.append(b)
            else:
                t = pa.Table.from_batches([*kept, b])
                cut = int(np.flatnonzero(_changes(t, keys))[-1])
                if cut:
                    yield from _batches(t.slice(0, cut))
                kept = t.slice(cut).combine_chunks().to_batches()
            held = ends[1]
        if kept:
            yield from _batches(pa.Table.from_batches(kept))

    def _batches(t):
        t = t.combine_chunks()
        for out in take(t, np.cumsum(_changes(t, keys)) - 1):
            yield from out.combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *inside).mapInArrow(work, schema)


def _cut(rows: DataFrame, keys: list[str], cells: list[tuple[int, int]], seed: int) -> DataFrame:
    """The rows, of keys of more than `HOT` without those that no sample can take: of each piece of such a key what a sample of the piece takes."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows_")).filter(F.col("rows_") > HOT)
    if sizes.isEmpty():
        return rows
    sizes, names = saved(sizes, "hot_keys"), rows.columns
    pieces = with_keys(rows, F.broadcast(sizes), keys, "left").withColumn("piece_", F.when(F.col("rows_").isNotNull(), F.pmod(F.xxhash64("suffix_"), F.ceil(F.col("rows_") / HOT))))

    def take(t: pa.Table, key: np.ndarray):
        keep = np.zeros(t.num_rows, bool)
        for _, _, own in _samples(t, key, cells, seed):
            keep[own] = True
        yield t.select(names).filter(pa.array(keep))

    cut = _by_key(pieces.filter("piece_ IS NOT NULL").drop("rows_"), [*keys, "piece_"], [], take, rows.schema)
    return cut.unionByName(pieces.filter("piece_ IS NULL").select(*names))


def landmarks(reads: DataFrame, m: int, seed: int = 42) -> DataFrame:
    """(patient, read_idx) of m reads; a limit by digest order needs no full sort."""
    return reads.select("patient", "read_idx").orderBy(hash_order(seed, F.col("patient"), F.col("read_idx")), "patient", "read_idx").limit(m)


def combinations(patients: DataFrame, size: int, count: int, seed: int = 42) -> DataFrame:
    """`count` distinct sets of `size` patients, by digest order (patients are few)."""
    out = patients.select(F.array("patient").alias("members"))
    for _ in range(size - 1):
        out = out.join(patients.select(F.col("patient").alias("p")), F.element_at("members", -1) < F.col("p")).select(F.concat("members", F.array("p")).alias("members"))
    return out.orderBy(hash_order(seed, F.array_join("members", ",")), "members").limit(count)


def downsample(df: DataFrame, keys: list[str], ident: str, most: int = 2_000_000, seed: int = 42) -> DataFrame:
    """At most `most` rows of each key, by digest order: the cap that densities of very many distances take."""
    return _ranked(df, seed, keys, ident).filter(F.col("rn") <= most).drop("rn")
