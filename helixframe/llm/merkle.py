"""Merkle manifest of a table: a tree over each group's rows, and one over the groups' roots.

Every row is a leaf, the digest of its fields. Within a group leaves stand in ascending id order; each `fanout` consecutive nodes
become their parent until one is left, the group's subroot. Subroots, in ascending order of the group's name, are the leaves of a last tree,
whose root stands for the whole table. Rows are numbered by a range sort and the counts of its partitions, so a group of any
size is spread over tasks; levels are stored tables, each a `fanout`-th of the one below. Paths of siblings are handed down from the
root: a join a level, of runs and not of rows, as all rows of a run share what is above it.

A null field counts as missing, which differs from an empty one; a null group is a group, the first. Equal ids stand in
order of their leaves; equal rows are leaves of their own. A null id stands first. Texts are hashed whole. An empty table has no rows, no root and no proofs.
Columns that are not named have no say, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

FANOUT = 16


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of texts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: of each field its length in UTF-8 bytes, a colon and its text, or a hyphen where it is null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(`rows` with `index`, the place within its `key` in ascending `order`, and `size`, the rows of that key; the largest size).

    `rows` is a stored table. Keys may be of any size: rows are range-sorted by (key, order), and a range's
    first place follows from the counts of the ranges before it, a row for each key that a range holds.
    """
    placed = saved(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = placed.groupBy("key", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("key")
    shift = F.sum("n").over(w.orderBy("part")) - F.col("n") - F.col("first")
    ranges = saved(counts.select("key", "part", shift.alias("shift"), F.sum("n").over(w).alias("size")), "ranges")
    most = ranges.agg(F.max("size")).first()[0] or 0
    out = placed.withColumn("part", part).join(ranges, ["key", "part"]).withColumn("index", F.col("at") + F.col("shift"))
    return out.drop("part", "at", "shift"), most


@dataclass
class Tree:
    """Trees of all keys: `levels` holds stored runs (key, run, size, children, digest), lowest first; `roots` (key, digest) of each key."""

    nodes: DataFrame
    levels: list[DataFrame]
    roots: DataFrame
    fanout: int

    def paths(self, above: DataFrame) -> DataFrame:
        """(`node`, path, columns of `above`) of each leaf; `above` has a row (key, path, ...) for each key.

        A path holds, from the leaf up, the joined digests of siblings before and after.
        """
        carried = [c for c in above.columns if c != "key"]
        up: DataFrame | None = None
        for runs in self.levels[::-1]:
            last = F.col("size") <= self.fanout
            known = runs.filter(last).join(above, "key")
            if up is not None:
                known = known.unionByName(runs.filter(~last).join(up, ["key", "run"]))
            digests = F.transform("children", lambda c: c.digest)
            at = F.col("at")
            beside = F.struct(_joined(F.slice(digests, F.lit(1), at)).alias("before"), _joined(F.slice(digests, at + 2, F.size("children"))).alias("after"))
            each = known.select("*", F.posexplode("children").alias("at", "node"))
            up = each.select("key", F.col("node.index").alias("run"), "node", F.concat(F.array(beside), "path").alias("path"), *[c for c in carried if c != "path"])
            if runs is not self.levels[0]:
                up = up.drop("node")
        alone = self.nodes.filter("size = 1").select("key", _node(self.nodes).alias("node")).join(above, "key").drop("key")
        return alone if up is None else alone.unionByName(up.drop("key", "run"))


def _node(nodes: DataFrame) -> Column:
    return F.struct("index", "digest", *[c for c in nodes.columns if c not in ("key", "index", "size", "digest")])


def grow(rows: DataFrame, order: list[str], fanout: int, name: str) -> Tree:
    """Trees over the rows (key, digest, ...) of a stored table, each key's in ascending `order`."""
    nodes, most = numbered(rows, order)
    levels, roots = [], [nodes.filter("size = 1").select("key", "digest")]
    level = nodes
    while most > 1:
        runs = level.filter("size > 1").groupBy("key", F.expr(f"index DIV {fanout}").alias("run")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(_node(level))).alias("children"))
        runs = saved(runs.withColumn("digest", digest(_joined(F.transform("children", lambda c: c.digest)))), f"{name}-{len(levels)}")
        levels.append(runs)
        roots.append(runs.filter(F.col("size") <= fanout).select("key", "digest"))
        level = runs.select("key", F.col("run").alias("index"), F.expr(f"(size + {fanout - 1}) DIV {fanout}").alias("size"), "digest")
        most = -(-most // fanout)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return Tree(nodes, levels, out, fanout)


@dataclass
class Manifest:
    """`groups`: the trees of all groups; `top`: the tree over their subroots, under one key."""

    groups: Tree
    top: Tree

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return self.top.roots.select(F.col("digest").alias("root"))

    def subroots(self) -> DataFrame:
        """(grp, subroot) of each group."""
        return self.groups.roots.select(F.expr("substr(key, 2)").alias("name"), "key", "digest").select(F.when(F.col("key") != "", F.col("name")).alias("grp"), F.col("digest").alias("subroot"))

    def nodes(self) -> DataFrame:
        """(grp, level, run, digest) of every inner node, to compare two manifests from their roots down; grp is null in the top tree, whose levels are negative."""
        grp = F.when(F.col("key") != "", F.expr("substr(key, 2)"))
        out = None
        for sign, tree in ((1, self.groups), (-1, self.top)):
            for k, runs in enumerate(tree.levels, 1):
                some = runs.select(grp.alias("grp"), F.lit(sign * k).alias("level"), "run", "digest")
                out = some if out is None else out.unionByName(some)
        return out if out is not None else self.groups.nodes.select(grp.alias("grp"), F.lit(0).alias("level"), F.col("index").alias("run"), "digest").limit(0)

    def proofs(self) -> DataFrame:
        """(id, leaf, other, subroot, root, path) of every row."""
        root = self.top.roots.select(F.col("key"), F.lit(None).cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root"))
        root = root.withColumn("path", F.coalesce("path", F.array().cast("array<struct<before:string,after:string>>")))
        top = saved(self.top.paths(root).select(F.col("node.name").alias("key"), F.col("node.digest").alias("subroot"), "root", "path"), "top")
        found = self.groups.paths(top)
        return found.select(F.col("node.id").alias("id"), F.col("node.digest").alias("leaf"), F.col("node.other").alias("other"), "subroot", "root", "path")


def manifest(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", group_col: str = "source", other: Column | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of `docs`. `other` is a leaf to carry beside each row's own, such as that of another version of the row."""
    name = F.col(group_col).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("key"),
        F.col(id_col).alias("id"),
        leaf(*[F.col(f) for f in fields]).alias("digest"),
        (F.lit(None).cast("string") if other is None else other).alias("other"),
    )
    groups = grow(saved(rows, "leaves"), ["id", "digest", "other"], fanout, "level")
    top = grow(saved(groups.roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "subroots"), ["name"], fanout, "top")
    return Manifest(groups, top)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda x, p: digest(p.before, x, p.after))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(_joined(F.transform(path, lambda p: F.concat(p.before, p.after))))
