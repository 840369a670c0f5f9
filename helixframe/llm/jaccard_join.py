"""Exact similarity join of documents under the Jaccard distance of their word shingles.

Unrelated texts lie at distance 1 from each other and from any pivot, so Voronoi cells over a whole corpus would copy
everything into every cell (windows of twice 1 - threshold around distances that all lie near 1). So the space is first
divided into subspaces, and inside them into Voronoi regions, again and again, until they are small:

1. Subspaces, of two kinds. "parts": the universe of shingles is dealt by hash into parts, more than two linked
   sets can differ in elements. So two linked sets agree on some part (distance 0 there): the sets that project onto the
   same thing form a subspace. Sizes fall into classes, and a set also enters the lower classes that its smallest partners
   belong to, so that linked sets use the same parts. "singles": a set enters the subspaces of its first
   (1 - threshold) * n + 1 shingles in one order of all, frequent ones last, and linked sets share one of those. Parts
   hardly meet by chance, however short the shingles; singles make fewer rows and suit shingles that are rare.
2. Pivots. A subspace's pivot is its set of the least key, so that a group of copies has the same pivot in all its
   subspaces; the subspaces of one pivot make up its cell. Sets linked with their pivot join its component. Only cells
   that still hold several components go on.
3. Voronoi regions. A cell of more than `block` sets gets pivots of its own, drawn from it by hash. Each set
   goes to the region of its nearest pivot by exact Jaccard distance, and by the triangle inequality a copy of it to every
   region whose pivot is at most 2 * (1 - threshold) farther: a set linked with it that lives there is no farther.
   Regions of more than `block` sets are divided again; those that did not shrink, or only hold one component, are not.
4. What meets in a region is compared exactly; parity sketches, whose Hamming distance never exceeds the number of
   elements that two sets differ in, leave out the sets that no pair of a region can link. Of the links found a task hands back
   as many as connect what they link, so no row stands for a pair: those of a group of near copies grow with its square.

Equal sets are one set throughout; copies never meet each other. Distances are whole-number comparisons of exact
intersections. Set keys have 64 bits; different sets that share one (a second digest tells) get other keys.

Null and empty texts have an empty set and are linked with nothing. Ids may be null (they can link others, but name
no component) or repeated (each row counts). Ties between pivots go to the lesser key. Very long texts are sets like others,
in memory one at a time. An empty table gives an empty one. Other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import flag_possible
from .common import Sequences, fresh, mix, saved, slices, starts_of, with_group, word_table

_SPACE = word_table("space")
SPARE = 3
GROWTH = 1.5


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; a text of fewer words is one shingle."""
    for i, j, w in slices(texts, _SPACE, lower=True):
        seq = Sequences(w.hashes())
        at = starts_of(w.first, k)
        h = seq.of(at, at + k)
        first = np.searchsorted(at, w.first)
        for d in range(j - i):
            if first[d] < first[d + 1]:
                yield np.unique(h[first[d] : first[d + 1]])
            elif w.first[d] < w.first[d + 1]:
                yield seq.of(w.first[d : d + 1], w.first[d + 1 : d + 2])
            else:
                yield np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least num / den."""

    num: int = 9
    den: int = 10

    def differences(self, a: int, b: int) -> int:
        """How many elements linked sets of a and b elements can differ in."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def classes(self, largest: int) -> tuple[list[int], list[int]]:
        """(lower bounds, parts) of the size classes up to `largest`; 0 parts where only equal sets are linked."""
        low, parts = [1], []
        while low[-1] <= largest:
            nxt = max(low[-1] + 1, int(low[-1] * GROWTH))
            most = self.differences(nxt - 1, (nxt - 1) * self.den // self.num)
            parts.append(most + 1 + SPARE if most else 0)
            low.append(nxt)
        return low, parts


def singles(u: np.ndarray, t: Threshold, frequent: np.ndarray) -> np.ndarray:
    """The regions of one set: its first shingles, frequent ones last. Any order is exact; this one keeps regions small."""
    n = len(u)
    h = mix(u ^ np.uint64(0x2545F4914F6CDD1D))
    if not n:
        return h
    late = np.zeros(n, bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)] == u
    first = n - -(-n * t.num // t.den) + 1
    return np.concatenate([np.sort(h[~late]), np.sort(h[late])])[:first]


def frequent_shingles(texts: DataFrame, k: int, most: int = 1 << 16) -> np.ndarray:
    """At most `most` shingles that many texts have, sorted. Each task counts a thousand texts at a time and reports
    what three of them, and one in a hundred, share; only sums of such counts are shuffled."""

    def work(batches):
        for b in batches:
            held, size = [], 0
            for u in [*shingle_sets(b.column(0), k), None]:
                if u is not None:
                    held.append(u)
                    size += len(u)
                if held and (u is None or len(held) == 1000 or size > 1 << 20):
                    v, c = np.unique(np.concatenate(held), return_counts=True)
                    often = c >= max(3, len(held) // 100)
                    yield pa.RecordBatch.from_arrays([pa.array(v[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["shingle", "n"])
                    held, size = [], 0

    counts = texts.mapInArrow(work, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def signatures(u: np.ndarray, t: Threshold) -> np.ndarray:
    """The regions of one set by parts: a hash of (class, part, projection) for each part of its classes.

    Of M parts at least M - differences agree; `SPARE` of them may be empty on both sides, so empty
    projections are left out unless the set has more than `SPARE` of them.
    """
    n = len(u)
    if not n:
        return u
    parts, out = _classes(t, n)[1], []
    v, where = mix(u ^ np.uint64(0x5851F42D4C957F2D)), mix(u ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(32)
    for c in own_classes(n, t):
        m = parts[c]
        if not m:
            continue
        part = (where * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(v[order], out=total[1:])
        ends = np.cumsum(np.bincount(part, minlength=m))
        begins = np.concatenate([[0], ends[:-1]])
        full = ends > begins
        use = full if m - int(full.sum()) <= SPARE else np.ones(m, bool)
        b = np.flatnonzero(use)
        out.append(mix((total[ends[b]] - total[begins[b]]) ^ mix((np.uint64(c) << np.uint64(40)) + b.astype(np.uint64) + np.uint64(1))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_made: dict[Threshold, tuple[int, list[int], list[int]]] = {}


def _classes(t: Threshold, n: int) -> tuple[list[int], list[int]]:
    if t not in _made or _made[t][0] < n:
        most = max(2 * n, 1 << 16)
        _made[t] = (most, *t.classes(most))
    return _made[t][1:]


def own_classes(n: int, t: Threshold) -> list[int]:
    """The class of a set of n elements, and the lower ones down to that of its smallest partner."""
    low = _classes(t, n)[0]
    own = [bisect.bisect_right(low, n) - 1]
    while own[-1] and -(-n * t.num // t.den) < low[own[-1]]:
        own.append(own[-1] - 1)
    return own


Clash = frozenset[int]


def _digests(u: np.ndarray, clash: Clash, bits: int = 64) -> tuple[int, int]:
    """(key, second digest) of a set. A key that different sets share leads on to another one."""
    with np.errstate(over="ignore"):
        a = mix(mix(u ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)[None] + np.uint64(len(u)))
        b = mix(u ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)[None]
        check = int(b.view(np.int64)[0])
        key = int((a >> np.uint64(64 - bits)).view(np.int64)[0])
        while key in clash:
            a = mix(a + b)
            key = int((a >> np.uint64(64 - bits)).view(np.int64)[0])
    return key, check


def keyed_sets(rows: DataFrame, k: int, clash: Clash, bits: int = 64) -> DataFrame:
    """(id, mark, n, s, check, sketch) of rows (id, mark, text): set size, set key, a second digest, parity sketch."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            n, s, c, sketch = [], [], [], []
            for u in shingle_sets(b.column(2), k):
                x, y = _digests(u, clash, bits)
                n.append(len(u))
                s.append(x)
                c.append(y)
                sketch.append(parity_sketch(u))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, pa.int64()) for x in (n, s, c)], pa.array(sketch, pa.binary())], ["id", "mark", "n", "s", "check", "sketch"])

    return rows.mapInArrow(work, f"id {kind}, mark bigint, n bigint, s bigint, check bigint, sketch binary")


MAX_CLASHES = 1 << 16


def keys_of(rows: DataFrame, k: int, bits: int = 64) -> tuple[DataFrame, Clash]:
    """(`keyed_sets`, keys given up): each key stands for one set. Clashes are expected from some ten billion sets on, and are few."""
    clash: Clash = frozenset()
    for _ in range(16):
        keyed = saved(keyed_sets(rows, k, clash, bits), "keyed")
        by_key = keyed.groupBy("s").agg(F.min("check").alias("a"), F.max("check").alias("b"), F.min("n").alias("c"), F.max("n").alias("d"))
        found = by_key.filter("a <> b or c <> d").select("s").limit(MAX_CLASHES + 1).collect()
        if not found:
            return keyed, clash
        clash = clash | {r.s for r in found}
        if len(clash) > MAX_CLASHES:
            break
    raise RuntimeError("too many different sets share a key")


def region_rows(texts: DataFrame, k: int, clash: Clash, t: Threshold, subspaces: str, bits: int = 64) -> DataFrame:
    """(region, s): every subspace of every text's set."""
    if subspaces not in ("parts", "singles"):
        raise ValueError("subspaces are 'parts' or 'singles'")
    frequent = frequent_shingles(texts, k) if subspaces == "singles" else None

    def work(batches):
        for b in batches:
            regions, keys, held = [], [], 0
            for u in shingle_sets(b.column(0), k):
                r = signatures(u, t) if frequent is None else singles(u, t, frequent)
                if len(r):
                    regions.append(r.view(np.int64))
                    keys.append(np.full(len(r), _digests(u, clash, bits)[0], np.int64))
                    held += len(r)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(regions)), pa.array(np.concatenate(keys))], ["region", "s"])
                    regions, keys, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(regions)), pa.array(np.concatenate(keys))], ["region", "s"])

    return texts.mapInArrow(work, "region bigint, s bigint")


def distances(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(s, p, both, either) of pairs (s, p): sizes of intersection and union, from the texts themselves."""

    def work(batches):
        for b in batches:
            both, either = [], []
            for x, y in zip(shingle_sets(b.column(2), k), shingle_sets(b.column(3), k)):
                n = len(np.intersect1d(x, y, assume_unique=True))
                both.append(n)
                either.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["s", "p", "both", "either"])

    own = texts.select("s", F.col("text").alias("own"))
    other = texts.select(F.col("s").alias("p"), F.col("text").alias("other"))
    return pairs.join(own, "s").join(other, "p").select("s", "p", "own", "other").mapInArrow(work, "s bigint, p bigint, both bigint, either bigint")


def components(edges: DataFrame) -> DataFrame:
    """(s, label): the smallest key reachable over edges (a, b). Labels spread to neighbours and then to their labels' labels."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("s")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("s")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("s") == F.col("a")).select("s", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        hop = labels.select(F.col("s").alias("mid"), F.col("label").alias("far"))
        new = saved(spread.join(hop, "mid").select("s", "old", F.least("mid", "far").alias("label")), "labels")
        labels = new.select("s", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def parity_sketch(u: np.ndarray) -> bytes:
    """One bit for each of 2 ** k buckets: whether it holds an odd number of elements; 0.75 to 1.5 bits an element.

    An element in one set only flips one bit, so the Hamming distance of two sketches is at most the number of elements
    that the sets differ in. Half a sketch xor the other half is the sketch of half as many buckets.
    """
    bits = 1 << max(8, int(3 * len(u) // 4 - 1).bit_length())
    odd = np.bincount((mix(u ^ np.uint64(0x9FB21C651E98DF25)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _fold(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.uint64)


def _allowed(a: dict[str, np.ndarray], i, b: dict[str, np.ndarray], j, across: bool, t: Threshold) -> np.ndarray:
    """Which pairs of rows (columns s, n, label, own, block) have anything to tell: other sets of other components, near in size, not both copies."""
    out = (a["label"][i] != b["label"][j]) & (a["own"][i] | b["own"][j]) & (a["s"][i] != b["s"][j]) & (a["n"][i] * t.den >= b["n"][j] * t.num) & (b["n"][j] * t.den >= a["n"][i] * t.num)
    return out & (a["block"][i] != b["block"][j]) if across else out


def _columns(rows: pa.Table) -> dict[str, np.ndarray]:
    return {c: np.asarray(rows[c]) for c in ("s", "n", "label", "own", "block")}


def _near(rows: pa.Table, t: Threshold) -> np.ndarray:
    """The rows of one block of a region that a pair has whose sketches allow a link: of the region's own sets, and of those with copies of others.

    Two sketches are compared at the size of the smaller one; sets too different in size are not compared at all.
    """
    raw, own = rows["sketch"].to_pylist(), _columns(rows)
    across, found = rows["x"][0].as_py() != rows["y"][0].as_py(), np.zeros(rows.num_rows, bool)
    length, n = np.array(list(map(len, raw)), np.int64), own["n"]
    for size in np.unique(length).tolist():
        first = np.flatnonzero(length == size)
        most_n = int(n[first].max()) * t.den // t.num
        at_ = np.concatenate([first, np.flatnonzero((length > size) & (n <= most_n))])
        bits = np.stack([_fold(raw[i], size) for i in at_.tolist()])
        of = {c: v[at_] for c, v in own.items()}
        for i in range(len(first)):
            at = np.flatnonzero(_allowed(of, i, of, slice(i + 1, None), across, t)) + i + 1
            if len(at):
                most = (of["n"][at] + of["n"][i]) * (t.den - t.num) // (t.den + t.num)
                at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1) <= most]
                if len(at):
                    found[at_[i]] = found[at_[at]] = True
    return np.flatnonzero(found)


def _dealt(leaves: DataFrame, m: Column) -> DataFrame:
    """Rows with (x, y, block): a region is dealt into m blocks, each pair of which meets; small regions stream by in the order of their keys."""
    dealt = leaves.withColumn("m", m.cast("int")).withColumn("block", F.pmod(F.xxhash64("s"), F.col("m")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda b: F.struct(F.least("block", b).alias("x"), F.greatest("block", b).alias("y")))
    dealt = dealt.withColumn("at", F.explode(others)).select("*", "at.x", "at.y").drop("at", "m")
    return dealt.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (cell, x, y) after the other, from batches in that order."""
    held = None
    for b in batches:
        t_ = pa.Table.from_batches([b])
        held = t_ if held is None else pa.concat_tables([held, t_])
        keys = [np.asarray(held[c]) for c in ("cell", "x", "y")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        at = 0
        for e in new.tolist():
            yield held.slice(at, e - at)
            at = e
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


_KINDS = {"cell": "bigint", "own": "boolean", "s": "bigint", "label": "bigint", "n": "bigint"}


def _candidates(leaves: DataFrame, t: Threshold, block: int) -> DataFrame:
    """(cell, own, s, label, n): the sets that may have a link in a region, of (cell, size, own, s, label, n, sketch). Pairs are not rows: their
    number grows with the square of a group of near copies."""

    def work(batches):
        for rows in _by_block(batches):
            at = _near(rows, t)
            if len(at):
                yield from rows.select(list(_KINDS)).take(pa.array(at)).combine_chunks().to_batches()

    return _dealt(leaves, F.ceil(F.col("size") / block)).select(*_KINDS, "sketch", "x", "y", "block").mapInArrow(work, ", ".join(f"{c} {k}" for c, k in _KINDS.items())).distinct()


#: Elements of the sets of a block that meets another, and shared shingles whose columns exist at once.
ELEMENTS, STRIP = 1 << 18, 2048


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one side with each of the other, by products over the shingles that both sides have."""
    sides = [(np.repeat(np.arange(len(x)), [len(u) for u in x]), np.concatenate(x)) for x in (a, b)]
    shared, out = np.intersect1d(sides[0][1], sides[1][1]), np.zeros((len(a), len(b)), np.int64)
    for at in range(0, len(shared), STRIP):
        strip, dense = shared[at : at + STRIP], []
        for (row, u), sets in zip(sides, (a, b)):
            place = np.minimum(np.searchsorted(strip, u), len(strip) - 1)
            has, m = strip[place] == u, np.zeros((len(sets), len(strip)), np.float32)
            m[row[has], place[has]] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _forest(labels: list[tuple[int, int]]) -> list[int]:
    """Which of some links between components tell something new, one after the other."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    new = []
    for i, (x, y) in enumerate(labels):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            new.append(i)
    return new


def _region_links(found: DataFrame, texts: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(a, b): enough links, each by an exact comparison, to connect what is linked in a region; of `_candidates` and (s, text)."""
    sums = found.groupBy("cell").agg(F.sum("n").alias("elements"), F.count("*").alias("size"))
    laid = with_group(found, saved(sums, "elements"), "cell", "size").join(texts, "s").select(*_KINDS, "elements", "text")

    def work(batches):
        for rows in _by_block(batches):
            x, y, own = rows["x"][0].as_py(), rows["y"][0].as_py(), _columns(rows)
            sides = [np.flatnonzero(own["block"] == z) for z in (x, y)]
            if not len(sides[0]) or not len(sides[1]):
                continue
            sets = list(shingle_sets(rows["text"].combine_chunks(), k))
            a, b = ({c: v[side] for c, v in own.items()} for side in sides)
            both = _intersections(*([sets[i] for i in side.tolist()] for side in sides))
            linked = _allowed(a, (slice(None), None), b, (None, slice(None)), x != y, t)
            linked &= both * t.den >= (a["n"][:, None] + b["n"][None, :] - both) * t.num
            i, j = np.nonzero(np.triu(linked) if x == y else linked)
            new = _forest(list(zip(a["label"][i].tolist(), b["label"][j].tolist())))
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(a["s"][i[new]]), pa.array(b["s"][j[new]])], ["a", "b"])

    dealt = _dealt(laid, F.ceil(F.col("elements") / ELEMENTS)).select(*_KINDS, "text", "x", "y", "block")
    return dealt.mapInArrow(work, "a bigint, b bigint").distinct()


def _possible(t: Threshold, n: str, m: str) -> Column:
    """Whether the sizes alone allow a link."""
    return (F.col(n) * t.den >= F.col(m) * t.num) & (F.col(m) * t.den >= F.col(n) * t.num)


def _near_pivots(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(s, p): the pairs of a set and its pivot whose sizes and sketches allow a link."""
    pivots = sets.select(F.col("s").alias("p"), F.col("n").alias("pn"), F.col("sketch").alias("psketch"))
    rows = pairs.join(sets, "s").join(pivots, "p").filter(_possible(t, "n", "pn"))
    most = F.floor((F.col("n") + F.col("pn")) * (t.den - t.num) / (t.den + t.num))

    def work(batches):
        for b in batches:
            x, y, top = (b.column(i).to_pylist() for i in (2, 3, 4))
            near = [int(np.bitwise_count(_fold(p, min(len(p), len(q))) ^ _fold(q, min(len(p), len(q)))).sum()) <= m for p, q, m in zip(x, y, top)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(near, pa.bool_())) for i in (0, 1)], ["s", "p"])

    return rows.select("s", "p", "sketch", "psketch", most.alias("most")).mapInArrow(work, "s bigint, p bigint")


@dataclass(frozen=True)
class Voronoi:
    """How cells are divided: until they have at most `block` sets, by about `fan` pivots at a time, at most `depth` times.

    What is larger then is compared block by block. A task holds `chunk` texts. No choice has any say in results.
    """

    block: int = 2048
    fan: int = 16
    depth: int = 6
    chunk: int = 256
    shrink: float = 0.7


def _nearest(t: Threshold, k: int):
    """The regions of some sets, by their exact distances to the cell's pivots: (cell, size, q, own, near, s, label); near: linked with pivot q."""
    kinds = {"cell": pa.int64(), "size": pa.int64(), "q": pa.int64(), "own": pa.bool_(), "near": pa.bool_(), "s": pa.int64(), "label": pa.int64()}

    def place(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        out = {c: [] for c in kinds}
        if rows.num_rows:
            pivots = pivots.sort_by("s")
            q, sets = np.asarray(pivots["s"]), list(shingle_sets(pivots["text"].combine_chunks(), k)) if pivots.num_rows else []
            universe = np.unique(np.concatenate(sets)) if sets else np.zeros(1, np.uint64)
            member = np.zeros((len(universe) + 1, len(sets)), np.int32)
            for j, v in enumerate(sets):
                member[np.searchsorted(universe, v), j] = 1
            size = np.array([len(v) for v in sets], np.int64)
            own, at = np.asarray(rows["own"]), np.zeros(1, np.int64)
            for i, u in enumerate(shingle_sets(rows["text"].combine_chunks(), k)):
                home, names, near = 0, np.zeros(1, np.int64), np.zeros(1, bool)
                if len(sets):
                    place = np.searchsorted(universe, u)
                    place[universe[np.minimum(place, len(universe) - 1)] != u] = len(universe)
                    both = member[place].sum(axis=0)
                    d = 1 - both / (len(u) + size - both)
                    home = int(np.argmin(d))
                    at = np.flatnonzero(d <= d[home] + 2 * (1 - t.num / t.den) + 1e-9)
                    names, near = q[at], (both * t.den >= (len(u) + size - both) * t.num)[at]
                for c, x in (("q", names), ("own", (at == home) & own[i]), ("near", near)):
                    out[c].append(x)
                for c in ("cell", "size", "s", "label"):
                    out[c].append(np.full(len(at), rows[c][i].as_py(), np.int64))
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in out.items()})

    return place


def _divide(cells: DataFrame, texts, t: Threshold, k: int, v: Voronoi, level: int) -> DataFrame:
    """(cell, size, q, own, near, s, label): the sets of large cells (cell, size, own, s, label) in the regions of their pivots q."""
    named = saved(texts(cells.select("s").distinct()), "texts")
    draw = F.pmod(F.xxhash64("s", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    chunks = F.ceil(F.col("size") / v.chunk).cast("int")
    pivots = cells.filter(draw * F.col("size") < v.fan).select("cell", "s", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")).join(named, "s")
    pivots = pivots.select("cell", "chunk", "s", "text").toDF("of", "part", "s", "text")
    rows = cells.withColumn("chunk", F.pmod(F.xxhash64("s"), chunks).cast("int")).join(named, "s").select("cell", "chunk", "size", "own", "s", "label", "text")
    out = rows.groupBy("cell", "chunk").cogroup(pivots.groupBy("of", "part")).applyInArrow(_nearest(t, k), "cell bigint, size bigint, q bigint, own boolean, near boolean, s bigint, label bigint")
    return saved(out, "regions")


def _relabel(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("label", "old").join(labels, "s", "left").withColumn("label", F.coalesce("label", "old")).drop("old")


def leaves(cells: DataFrame, links: DataFrame, labels: DataFrame, texts, t: Threshold, k: int, v: Voronoi) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(regions, links, labels) of cells (cell, s, label): the regions (cell, size, own, s, label) in which sets of several
    components meet, None without any; the links (a, b) so far with those to pivots, and the labels (s, label) that they make.

    A set's own region is its nearest pivot's at every level; elsewhere it is a copy, and copies need not meet each other.
    A cell whose sets lie too close together, so that copies are more than its sets, stays whole.
    texts gives (s, text) of wanted keys (s).
    """
    cells, done = cells.select("cell", F.lit(None).cast("bigint").alias("parent"), F.lit(True).alias("own"), "s", "label"), []
    shape = ["cell", "size", "own", "s", "label"]
    for level in range(v.depth + 1):
        sizes = cells.groupBy("cell").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("own").alias("any"))
        sizes = saved(sizes.filter("lo <> hi AND any").select("cell", "size"), "sizes")
        if sizes.isEmpty():
            break
        laid = with_group(cells, sizes, "cell", "size").select("parent", *shape)
        if level == v.depth or sizes.filter(F.col("size") > v.block).isEmpty():
            done.append(laid.select(*shape))
            break
        large = (F.col("size") > v.block) & (F.col("parent").isNull() | (F.col("size") < v.shrink * F.col("parent")))
        done.append(laid.filter(~large).select(*shape))
        more = saved(laid.filter(large).select(*shape), "large")
        if more.isEmpty():
            break
        divided = _divide(more, texts, t, k, v, level)
        links = saved(links.unionByName(divided.filter("near AND s <> q").select(F.col("s").alias("a"), F.col("q").alias("b")).distinct()), "links")
        labels = components(links)
        totals = divided.groupBy("cell").agg(F.count("*").alias("n"), F.max("size").alias("size")).select("cell", "size", (F.col("n") > 2 * F.col("size")).alias("whole"))
        totals = saved(totals, "totals")
        whole = with_group(more.drop("size"), totals.filter("whole"), "cell", "size").select("cell", F.lit(0).cast("bigint").alias("parent"), "own", "s", "label")
        parted = with_group(divided.drop("size"), totals.filter("NOT whole"), "cell", "size").select(F.xxhash64("cell", "q", F.lit(level)).alias("cell"), F.col("size").alias("parent"), "own", "s", "label")
        cells = saved(_relabel(whole.unionByName(parted), labels), "cells")
    met = reduce(DataFrame.unionByName, done) if done else None
    return (_relabel(met, labels) if met is not None and level else met), links, labels


def texts_of(rows: DataFrame, keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, text) of the wanted sets, from one row each. A Bloom filter of bounded size keeps other rows' texts out of the shuffle."""
    first = keyed.groupBy("s").agg(F.min(F.struct("id", "mark")).alias("x")).join(wanted, "s", "left_semi")
    first = saved(first.select("s", F.col("x.id").alias("id"), F.col("x.mark").alias("mark")), "wanted")
    r, f = flag_possible(rows, "mark", first, "mark", "possible").filter("possible").alias("r"), first.alias("f")
    return r.join(f, F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.mark") == F.col("f.mark"))).select("f.s", "r.text").dropDuplicates(["s"])


def _links(pairs: DataFrame, rows: DataFrame, keyed: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(a, b): the pairs (s, p) that are linked, by an exact comparison of their texts."""
    pairs = saved(pairs, "near")
    texts = saved(texts_of(rows, keyed, pairs.select("s").union(pairs.select(F.col("p").alias("s"))).distinct()), "texts")
    exact = distances(pairs, texts, k).filter(F.col("both") * t.den >= F.col("either") * t.num)
    return saved(exact.select(F.col("s").alias("a"), F.col("p").alias("b")), "links")


def linked_labels(regions: DataFrame, rows: DataFrame, keyed: DataFrame, k: int, t: Threshold, v: Voronoi = Voronoi()) -> DataFrame | None:
    """(s, label) of the sets that have links, from subspaces (region, s); None if no two sets share one."""
    pivots = regions.groupBy("region").agg(F.min("s").alias("p"), F.max("s").alias("hi")).filter("p <> hi").select("region", "p")
    pairs = saved(regions.join(pivots, "region").filter("s <> p").select("s", "p").distinct(), "pairs")
    if pairs.isEmpty():
        return None
    involved = pairs.select("s").union(pairs.select(F.col("p").alias("s"))).distinct()
    sets = saved(keyed.select("s", "n", "sketch").dropDuplicates(["s"]).join(involved, "s", "left_semi"), "sketches")
    first = _links(_near_pivots(pairs, sets, t), rows, keyed, k, t)
    labels = components(first)
    cells = pairs.join(labels, "s", "left").select(F.col("p").alias("cell"), "s", F.coalesce("label", "s").alias("label"))
    met, first, labels = leaves(cells, first, labels, lambda wanted: texts_of(rows, keyed, wanted), t, k, v)
    if met is None:
        return labels
    found = saved(_candidates(met.join(sets, "s"), t, v.block), "found")
    texts = saved(texts_of(rows, keyed, found.select("s").distinct()), "texts")
    more = saved(_region_links(found, texts, k, t), "links")
    return labels if more.isEmpty() else components(first.unionByName(more))


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: Threshold = Threshold(), subspaces: str = "parts", voronoi: Voronoi = Voronoi(), key_bits: int = 64) -> DataFrame:
    """(id, mark, n, group) of every row: mark is xxhash64 of the text; group names the component, null for empty sets."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    keyed, clash = keys_of(rows, k, key_bits)
    regions = region_rows(rows.select("text"), k, clash, threshold, subspaces, key_bits)
    labels = linked_labels(regions, rows, keyed, k, threshold, voronoi)
    group = F.when(F.col("n") > 0, F.col("s"))
    if labels is not None:
        labels = labels.join(keyed.groupBy("s").agg(F.count("*").alias("copies")), "s")
        keyed, group = with_group(keyed, saved(labels, "copies"), "s", "copies", "left"), F.when(F.col("n") > 0, F.coalesce("label", "s"))
    return keyed.select("id", "mark", "n", group.alias("group"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_shingles, component) of every row: set size and the smallest id reachable by links, itself included."""
    rows = saved(jaccard_groups(docs, id_col=id_col, **options), "groups")
    least = saved(rows.filter("n > 0").groupBy("group").agg(F.min("id").alias("component"), F.count("*").alias("size")), "least")
    full = with_group(rows.filter("n > 0"), least, "group", "size").select("id", "n", "component")
    empty = rows.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, that of the smallest id (nulls last, then by text hash), and all rows without words."""
    rows = saved(jaccard_groups(docs, id_col=id_col, text_col=text_col, **options).filter("n > 0"), "groups")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    best = saved(rows.groupBy("group").agg(F.min(order).alias("x"), F.count("*").alias("size")).filter("size > 1"), "best")
    lost = with_group(rows, best, "group", "size").filter(~(F.col("id").eqNullSafe(F.col("x.id")) & (F.col("mark") == F.col("x.mark")))).select("id", "mark").distinct()
    lost = saved(lost, "lost")
    again = saved(rows.groupBy("id", "mark").count().filter("count > 1").select("id", "mark"), "again")
    mark, possible = fresh(docs, "mark"), fresh(docs, "possible")
    touched = lost.unionByName(again)
    flagged = flag_possible(docs.withColumn(mark, F.xxhash64(text_col)), mark, touched, "mark", possible)
    clear, some = flagged.filter(~F.col(possible)), flagged.filter(possible)
    same = lambda f: (F.col(f"d.{id_col}").eqNullSafe(F.col(f"{f}.id"))) & (F.col(f"d.{mark}") == F.col(f"{f}.mark"))
    kept = some.alias("d").join(lost.alias("l"), same("l"), "left_anti")
    if not again.isEmpty():
        once = kept.alias("d").join(again.alias("a"), same("a"), "left_anti")
        kept = once.unionByName(kept.alias("d").join(again.alias("a"), same("a"), "left_semi").dropDuplicates([id_col, mark]))
    return clear.unionByName(kept).drop(mark, possible)
