"""Ranks, areas and densities as expressions and small plans; named aggregators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def auc(df: DataFrame, value: str, positive: Column, keys: list[str]) -> DataFrame:
    """(keys, auc, n_pos, n_neg): the normalised rank sum of the positives, ties sharing their mean rank; null where a class is empty.

    Rows are counted by value first, and prefix sums run by range of values, so no key's rows meet in one task.
    """
    counts = df.groupBy(*keys, F.col(value).alias("v_")).agg(F.count_if(positive).alias("p_"), F.count_if(~F.coalesce(positive, F.lit(False))).alias("n_"))
    run = running_before(counts, "v_", ["n_"], keys)
    p, n = F.sum("p_"), F.sum("n_")
    won = F.sum(F.col("p_") * (F.col("before_n_") + F.col("n_") / 2))
    return run.groupBy(*keys).agg((won / F.nullif(p * n, F.lit(0))).alias("auc"), p.alias("n_pos"), n.alias("n_neg"))


AGGREGATORS: dict[str, object] = {}


def register_aggregator(name: str, make) -> None:
    """Add a named aggregator for `aggregate_all`: make(value column) gives an aggregate expression."""
    if name in AGGREGATORS or name in ("max", "mean", *QUANTILES):
        raise ValueError(f"there is an aggregator {name}")
    AGGREGATORS[name] = make


def with_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which a null equals a null; keys stand once."""
    named = right.withColumnsRenamed({k: f"{k}_r_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"{k}_r_"])
    return left.join(named, on, how).drop(*[f"{k}_r_" for k in keys])


def aggregate_all(df: DataFrame, keys: list[str], value: str = "score", tops: tuple[int, ...] = (100, 500)) -> DataFrame:
    """(keys, aggregator, value) for every named aggregator: max, mean, median, percentiles, means of the top k (all rows if fewer), and registered ones.

    Values are counted first. A prefix sum of the counts says which ranks of its key a value holds, and with them whether it is a
    quantile's neighbour and how often it is among the top k: everything is a sum over values, and no key's rows meet in one task.
    """
    v = F.col(value)
    counts = df.groupBy(*keys, v).agg(F.count("*").alias("c_"))
    sizes = counts.filter(v.isNotNull()).groupBy(*keys).agg(F.sum("c_").alias("n_"))
    run = with_keys(running_before(counts.filter(v.isNotNull()), value, ["c_"], keys), sizes, keys)
    before, c, n = F.col("before_c_"), F.col("c_"), F.col("n_")

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < before + c), v))

    spots, parts = {}, []
    for name, q in QUANTILES.items():
        spot = F.lit(q) * (n - 1)
        parts += [at(F.floor(spot)).alias(f"{name}_a"), at(F.ceil(spot)).alias(f"{name}_b"), F.first(spot - F.floor(spot)).alias(f"{name}_s")]
        spots[name] = F.col(f"{name}_a") + F.col(f"{name}_s") * (F.col(f"{name}_b") - F.col(f"{name}_a"))
    for k in tops:
        taken = F.greatest(F.lit(0), F.least(c, F.lit(k) - (n - before - c)))
        parts.append((F.sum(taken * v) / F.sum(taken)).alias(f"top{k}"))
    wide = run.groupBy(*keys).agg(F.max(v).alias("max"), (F.sum(c * v) / F.sum(c)).alias("mean"), *parts)
    named = wide.select(*keys, F.col("max").cast("double").alias("max"), "mean", *[x.cast("double").alias(name) for name, x in spots.items()], *[f"top{k}" for k in tops])
    if AGGREGATORS:
        named = with_keys(named, df.groupBy(*keys).agg(*[make(v).cast("double").alias(name) for name, make in AGGREGATORS.items()]), keys)
    return named.unpivot(keys, ["max", "mean", *QUANTILES, *[f"top{k}" for k in tops], *AGGREGATORS], "aggregator", "value")


def hash_order(seed: int, *parts) -> Column:
    """A reproducible pseudo-random order: the same digest in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def bandwidth(n: Column, deviation: Column) -> Column:
    """Scott's rule in one dimension."""
    return deviation * F.pow(n, F.lit(-0.2))


CHUNK = 4096
#: Numbers that a task hands back at once.
NUMBERS = 1 << 18


def _bumps(g: dict, points: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of Gaussian bumps around some counted values, at the points of a grid."""
    x, y = g["lo"] + np.arange(g["m"]) * g["step"], np.zeros(g["m"])
    for i in range(0, len(points), 64):
        z = (x[:, None] - points[None, i : i + 64]) / g["h"]
        y += np.exp(-0.5 * z * z) @ counts[i : i + 64]
    return y


def gaussian_density(points: DataFrame, grids: DataFrame, keys: list[str], value: str, own: list[str] | None = None, curves: bool = False) -> DataFrame:
    """(keys, grid_i, x, y): kernel density of each key's points on its own grid; with `curves`, (keys, lo, step, ys), a row a grid.

    grids: (keys, n, h, lo, step, m) with h the bandwidth and n what sums are divided by; where that is not the number of the key's points, `size` says how many they are. `own` are the keys that points have (all, if not given): a subject's
    points may lie on the grids of many pairs, which they meet as one list. Equal values are counted first, and packed about `CHUNK` at a time
    by hash, so a key's points never meet in one task. What one chunk gives is a density as it is; only where there are more are they
    added up by point, so in general no row a point is shuffled. Tasks hand curves back `NUMBERS` at a time, whatever their grids.
    """
    own = keys if own is None else own
    rest = [c for c in keys if c not in own]
    lists = grids.groupBy(*own).agg(F.collect_list(F.struct(*rest, "n", "h", "lo", "step", "m")).alias("grids_"), F.ceil(F.max("size" if "size" in grids.columns else "n") / CHUNK).cast("int").alias("chunks_"))
    counted = points.groupBy(*own, F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("c")).join(lists.select(*own, "chunks_"), own)
    packed = counted.groupBy(*own, "chunks_", F.pmod(F.xxhash64("v"), F.col("chunks_")).alias("chunk_")).agg(F.collect_list(F.struct("v", "c")).alias("values_"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = packed.join(lists.select(*own, "grids_"), own).select(*own, "chunks_", "chunk_", "grids_", "values_").repartition(parts, *own, "chunk_")
    kind = met.schema["grids_"].dataType.elementType
    fields = T.StructType([*[met.schema[c] for c in own], T.StructField("chunks_", T.IntegerType()), *kind.fields, T.StructField("y_", T.ArrayType(T.DoubleType()))])
    names = [c.name for c in kind.fields]

    def work(batches):
        for b in batches:
            rows, on, sums, held = [], [], [], 0
            for i, v in enumerate(b.column("values_")):
                values, counts = np.asarray(v.values.field("v")), np.asarray(v.values.field("c"))
                for g in b.column("grids_")[i].values:
                    g = g.as_py()
                    rows.append(i)
                    on.append(g)
                    sums.append(_bumps(g, values, counts))
                    held += len(sums[-1])
                    if held >= NUMBERS:
                        yield batch(b, rows, on, sums)
                        rows, on, sums, held = [], [], [], 0
            if rows:
                yield batch(b, rows, on, sums)

    def batch(b, rows, on, sums):
        at, ends = pa.array(rows), np.cumsum([0, *map(len, sums)])
        shared = b.schema.field("grids_").type.value_type
        y = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sums)))
        return pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in [*own, "chunks_"]], *[pa.array([g[c] for g in on], shared.field(c).type) for c in names], y], [*own, "chunks_", *names, "y_"])

    def done(y: Column, n: Column, h: Column) -> Column:
        return (y / (n * h * math.sqrt(2 * math.pi))).alias("y")

    place = lambda lo, step: (lo + F.col("grid_i") * step).alias("x")
    made, many = (met.filter(c).mapInArrow(work, fields) for c in ("chunks_ = 1", "chunks_ > 1"))
    one, many = (x.select(*keys, "n", "h", "lo", "step", F.posexplode("y_").alias("grid_i", "y_")) for x in (made, many))
    if curves:
        whole = made.select(*keys, "lo", "step", F.transform("y_", lambda y: done(y, F.col("n"), F.col("h"))).alias("ys"))
        summed = many.groupBy(*keys, "grid_i").agg(F.first("lo").alias("lo"), F.first("step").alias("step"), done(F.sum("y_"), F.first("n"), F.first("h")))
        return whole.unionByName(summed.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("step").alias("step"), F.array_sort(F.collect_list(F.struct("grid_i", "y"))).y.alias("ys")))
    whole = one.select(*keys, "grid_i", place(F.col("lo"), F.col("step")), done(F.col("y_"), F.col("n"), F.col("h")))
    summed = many.groupBy(*keys, "grid_i").agg(place(F.first("lo"), F.first("step")), done(F.sum("y_"), F.first("n"), F.first("h")))
    return whole.unionByName(summed)


def at_rank(x: np.ndarray, rank: int) -> tuple[float, int, int]:
    """(value, rows below it, rows equal to it within 1e-12) of a rank in sorted values."""
    value = float(x[rank])
    first, last = np.searchsorted(x, value - 1e-12), np.searchsorted(x, value + 1e-12, "right")
    return value, int(first), int(last - first)


def value_at_rank(df: DataFrame, column: str, rank: int, n: int, held: int = 1 << 20, bins: int = 4096) -> tuple[float, int, int]:
    """(value, rows below it, rows equal to it) of the row of a rank (from 0) in ascending order of n finite values.

    Counts by bin narrow the range until its values fit the driver (`held`); no value is looked at twice in a task.
    """
    v, lo, below = F.col(column), None, 0
    rows = df.select(column)
    while n > held:
        ends = rows.agg(F.min(v).alias("a"), F.max(v).alias("b")).first()
        lo, hi = float(ends.a), float(ends.b)
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            return lo, below, n
        at = F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int")
        counts = dict(rows.groupBy(at.alias("at")).count().collect())
        k = 0
        while rank >= counts.get(k, 0):
            rank, below, k = rank - counts.get(k, 0), below + counts.get(k, 0), k + 1
        rows, n = rows.filter(at == k), counts[k]
    x = np.sort(np.asarray(rows.toArrow()[column], dtype=np.float64))
    value, first, equal = at_rank(x, rank)
    return value, below + first, equal


def quantiles(df: DataFrame, column: str, qs: dict[str, float]) -> DataFrame:
    """One row: the interpolated quantiles of a whole table's values by name (nulls and NaN left out; null where there is none).

    Values are counted once; prefix sums by range say which ranks each holds, so all quantiles come from one pass over the counts.
    """
    v = F.col(column)
    counts = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(v).agg(F.count("*").alias("c_"))
    size = counts.agg(F.sum("c_").alias("n_"))
    run = running_before(counts, column, ["c_"]).join(F.broadcast(size), F.lit(True))
    before, c, picks = F.col("before_c_"), F.col("c_"), []
    for name, q in qs.items():
        spot = F.lit(q) * (F.col("n_") - 1)
        low, high = (F.max(F.when((before <= r) & (r < before + c), v)) for r in (F.floor(spot), F.ceil(spot)))
        picks.append((low + F.max(spot - F.floor(spot)) * (high - low)).alias(name))
    return run.agg(*picks)


def trapezoid(df: DataFrame, keys: list[str], y: Column, order: str = "grid_i", x: str = "x") -> DataFrame:
    """(keys, area) under y over x."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = df.withColumn("y_", y).withColumn("part_", (F.col(x) - F.lag(x).over(w)) * (F.col("y_") + F.lag("y_").over(w)) / 2)
    return steps.groupBy(*keys).agg(F.sum("part_").alias("area"))


MOST_PARTS = 512


def running_before(df: DataFrame, order: str, columns: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds before_<c>, the sum of c over all rows before in `order` (distinct numbers; a null is last), within keys if given.

    Rows are dealt to ranges between cut points, then summed by range (a row each, or one for each key in it) and inside. The cut points are
    quantiles of all rows, so a range holds few of them, whatever their keys; they are values in the plan, so both readers of the
    table deal its rows alike, however Spark partitions them.
    """
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_PARTS)
    cuts = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    part = F.when(F.col(order).isNull(), F.lit(len(cuts))).otherwise(part)
    return _within_parts(df.withColumn("part_", part), [order], columns, keys)


def _within_parts(placed: DataFrame, order: list, columns: list[str], keys: list[str]) -> DataFrame:
    """Prefix sums of rows that are dealt to parts (part_) in ascending order."""
    totals = placed.groupBy(*keys, "part_").agg(*[F.sum(c).alias(f"t_{c}") for c in columns])
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("part_")
    bases = totals.select(*keys, "part_", *[(F.sum(f"t_{c}").over(w) - F.col(f"t_{c}")).alias(f"b_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "part_").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = with_keys(placed, bases, [*keys, "part_"]) if keys else placed.join(F.broadcast(bases), "part_")
    for c in columns:
        out = out.withColumn(f"before_{c}", F.col(f"b_{c}") + F.sum(c).over(inside) - F.col(c))
    return out.drop("part_", *[f"b_{c}" for c in columns])


def digest_rank(df: DataFrame, digest: Column, ident: str, keys: list[str]) -> DataFrame:
    """Adds rn, the place from 1 within keys in order of a hexadecimal digest, then `ident`.

    Digests are spread evenly, so their first digits deal the rows of any key to parts of even size.
    """
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_PARTS)
    head = F.conv(F.substring("digest_", 1, 6), 16, 10).cast("long")
    placed = df.withColumn("digest_", digest).withColumn("one_", F.lit(1)).withColumn("part_", F.floor(head * parts / (1 << 24)).cast("int"))
    return _within_parts(placed, ["digest_", ident], ["one_"], keys).withColumn("rn", F.col("before_one_") + 1).drop("digest_", "one_", "before_one_")


def auc_of_reads(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """(auc, n_pos, n_neg) over a whole table."""
    return auc(df, value, positive, [])


def spearman(df: DataFrame, a: str, b: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, spearman, n): correlation of average ranks (nulls last), NaN where all of one side are equal. Ranks are those of counted values; rows
    get them by a join on the value.

    Twice a rank is an integer, and twice the ranks of n rows have the mean n + 1, so sums of products are exact and equal values have no
    spread, however rows are partitioned. Deviations by partition are not: merged, those of equal values may differ from zero.
    """
    rows = df.select(*keys, F.col(a).alias("a_"), F.col(b).alias("b_"))
    for v in ("a_", "b_"):
        counts = rows.groupBy(*keys, v).agg(F.count("*").alias("c_"))
        ranks = running_before(counts, v, ["c_"], keys).select(*keys, v, (2 * F.col("before_c_") + F.col("c_") + 1).alias(f"r{v}"))
        rows = with_keys(rows, ranks, [*keys, v])
    product = lambda x, y: F.sum((F.col(x) * F.col(y)).cast("decimal(20,0)"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), product("ra_", "rb_").alias("ab"), product("ra_", "ra_").alias("aa"), product("rb_", "rb_").alias("bb"))
    n = F.col("n").cast("decimal(12,0)")
    about = lambda c: (F.col(c) - n * (n + 1) * (n + 1)).cast("double")
    spread = F.nullif(F.sqrt(about("aa") * about("bb")), F.lit(0.0))
    rho = F.coalesce(about("ab") / spread, F.when(F.col("n") > 0, F.lit(float("nan"))))
    return sums.select(*keys, rho.alias("spearman"), "n")
