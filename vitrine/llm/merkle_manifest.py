"""Merkle manifest of a dataset by a persistent, path-copying hash tree.

Each row is a leaf, the digest of its fields. The leaves of a tree (here: a language) ascend by their order; while
several nodes remain, every two consecutive ones, or a last lone one, become their digest. The subroots of all trees,
ordered by tree, make the root of the forest in the same way.

Distributed build. Leaves are dealt in ranges of (tree, order) and numbered by running counts of the ranges, so a tree
of a third of all rows is spread over as many tasks as it needs. 2^`LEVELS` consecutive, aligned leaves are one block:
one row that holds its leaves and its nodes. The roots of blocks are the leaves of the next level of blocks, up to one
block a tree; the forest is one more tree. Downwards each block hands its children the path from their root to the
forest's root: the siblings that versions of this child share with the original.

Versions. Blocks are persistent trees: nodes are never changed, and a changed leaf makes a version whose root is a new
node; only the leaf's ancestors are copied, all other nodes are shared with version 0. The version is continued above
its block along the block's path, in the block's own task, so versions are as distributed as leaves are.

Every digest is a function of the rows alone, stored tables cut the lineage between levels, and no task holds more than
a block's rows. Nulls: a null field is `-`; a null tree is a tree of its own and comes first; a null order value comes
first. Rows with equal order ascend by digest, and equal rows are leaves of their own. An empty table has no rows. A
null id is not tampered with, nor is a row without the number that tampering raises. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.llm.common import stored

#: Levels of an aligned block, which has up to 2^LEVELS leaves.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NUMBERS = ("doc_id", "n_chars")
#: Rows whose id has a CRC that this divides are tampered with.
TAMPERED = 7


#: Blocks worked on at a time.
BLOCKS = 16


def by_blocks(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A few blocks of a batch at a time, as each gives many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCKS):
                yield fn(batch.slice(at, BLOCKS))

    return run


def digest(*parts: str) -> str:
    """H: digests enter as their hex text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as its byte count, a colon and its text; null is `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def document_leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """tree (of the language), doc_id, leaf, changed (the tampered row's leaf, null where nothing was changed)."""
    values = [F.col(c).cast("decimal(38,0)") if c in NUMBERS else F.col(c).cast("string") for c in FIELDS]
    raised = [v + 1 if c == "n_chars" else v for c, v in zip(FIELDS, values, strict=True)]
    hit = F.col("doc_id").isNotNull() & F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered == 0)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf(values).alias("leaf"), F.when(hit, leaf(raised)).alias("changed"),
    )


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The nodes with their place in their tree (`pos`) and the tree's size (`total`)."""
    # the last key spreads equal rows, which may be many and are interchangeable
    ranged = stored(nodes, "nodes").withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_row").sortWithinPartitions("tree", *order, "_row")
    placed = stored(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("tree", "_range").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "_range", (before - F.col("_first")).alias("_shift"), F.sum("n").over(tree).alias("total"))
    return placed.join(starts, ["tree", "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_range")


class Tree:
    """A persistent tree over a block's leaves. Nodes are only appended; a version is the index of its root."""

    def __init__(self, leaves: list[str], levels: int):
        self.nodes, self.rows = list(leaves), [list(range(len(leaves)))]
        for _ in range(levels):
            below, above = self.rows[-1], []
            for i in range(0, len(below), 2):
                above.append(len(self.nodes))
                self.nodes.append(digest(*(self.nodes[k] for k in below[i : i + 2])))
            self.rows.append(above)
        self.root = self.rows[-1][0]

    def siblings(self, pos: int) -> Iterator[tuple[bool, str | None]]:
        """(it stands left, digest) of each level from the leaf up; no digest where a node is alone."""
        for row in self.rows[:-1]:
            beside = pos ^ 1
            yield beside < pos, self.nodes[row[beside]] if beside < len(row) else None
            pos >>= 1

    def version(self, pos: int, changed: str) -> int:
        """The root of a version with one other leaf: its ancestors are copied, all else is shared."""
        self.nodes.append(changed)
        for left, beside in list(self.siblings(pos)):
            self.nodes.append(joined(self.nodes[-1], left, beside))
        return len(self.nodes) - 1


def joined(node: str, left: bool, beside: str | None) -> str:
    """The parent of a node and its sibling, if it has one."""
    return digest(node) if beside is None else digest(beside, node) if left else digest(node, beside)


def raised(node: str, path: list[dict]) -> str:
    """The root that a node leads to along a path of shared siblings."""
    return reduce(lambda below, step: joined(below, step["is_left"], step["digest"]), path, node)


_PATH = "array<struct<is_left:boolean,digest:string>>"
_STEPS = pa.list_(pa.struct([("is_left", pa.bool_()), ("digest", pa.string())]))


def _height(size: int, total: int, levels: int) -> int:
    """Levels of a block: all where its tree goes on above it, else as many as its leaves need."""
    return levels if total > 1 << levels else (size - 1).bit_length()


def grown(nodes: DataFrame, columns: list[str], levels: int) -> list[DataFrame]:
    """Blocks of each level, the leaves' first: tree, block, total, root, leaves (in order: leaf and `columns`)."""
    out = []
    while True:
        leaves = F.transform(F.array_sort(F.collect_list(F.struct("pos", "leaf", *columns))), lambda x: x.dropFields("pos"))
        rows = (
            nodes.withColumn("block", F.shiftright("pos", levels)).groupBy("tree", "block")
            .agg(F.max("total").alias("total"), leaves.alias("leaves"))  # at most 2^levels in a group
        )
        schema = rows.select("*", F.lit("").alias("root")).schema

        def build(batch: pa.RecordBatch) -> pa.RecordBatch:
            roots = []
            for own, total in zip(batch.column("leaves").to_pylist(), batch.column("total").to_pylist(), strict=True):
                tree = Tree([x["leaf"] for x in own], _height(len(own), total, levels))
                roots.append(tree.nodes[tree.root])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "root"])

        out.append(stored(rows.mapInArrow(by_blocks(build), schema), "blocks"))
        above = out[-1].where(F.col("total") > 1 << levels)
        if above.isEmpty():
            return out
        nodes, columns = above.select(
            "tree", F.col("block").alias("pos"), F.col("root").alias("leaf"), F.shiftright(F.col("total") + (1 << levels) - 1, levels).alias("total")
        ), []


def _paths(levels: int):
    """Paths of a block's children: their siblings in the block, then the block's own path."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, blocks, paths = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("block", "total", "leaves", "path"))
        for row, (block, total, own, path) in enumerate(zip(*columns, strict=True)):
            tree = Tree([x["leaf"] for x in own], _height(len(own), total, levels))
            for pos in range(len(own)):
                rows.append(row)
                blocks.append((block << levels) + pos)
                paths.append([{"is_left": left, "digest": beside} for left, beside in tree.siblings(pos)] + path)
        kept = batch.select(["tree", "subroot", "root"]).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(blocks, pa.int64()), pa.array(paths, _STEPS)], ["tree", "subroot", "root", "block", "path"])

    return by_blocks(run)


def descended(grown_blocks: list[DataFrame], start: DataFrame, levels: int) -> DataFrame:
    """tree, block, path, subroot, root of each block of the lowest level; `start` has those of the highest ones."""
    for i in range(len(grown_blocks) - 1, 0, -1):
        # trees whose one block lies lower join the descent there
        here = grown_blocks[i].select("tree", "block", "total", "leaves")
        below = here.join(start, ["tree", "block"]).mapInArrow(_paths(levels), f"tree string, subroot string, root string, block long, path {_PATH}")
        start = stored(below.unionByName(start.join(here.select("tree"), "tree", "left_anti")), "paths")
    return start


def _folded(levels: int):
    """Leaves of blocks with their proofs and the roots that their versions lead to."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, leaves, proofs, folded, copied = [], [], [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("total", "leaves", "path"))
        for row, (total, own, path) in enumerate(zip(*columns, strict=True)):
            tree = Tree([x["leaf"] for x in own], _height(len(own), total, levels))
            original, above = raised(tree.nodes[tree.root], path), [s["digest"] for s in path if s["digest"] is not None]
            for pos, x in enumerate(own):
                rows.append(row)
                ids.append(x["doc_id"])
                leaves.append(x["leaf"])
                proofs.append([d for _, d in tree.siblings(pos) if d is not None] + above)
                if x["changed"] is None:  # version 0: every node is shared
                    folded.append(original)
                    copied.append(0)
                else:
                    folded.append(raised(tree.nodes[tree.version(pos, x["changed"])], path))
                    copied.append(len(tree.rows) - 1 + len(path))
        kept = batch.select(["subroot", "root"]).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(leaves, pa.string()), *kept.columns, pa.array(proofs, pa.list_(pa.string())), pa.array(folded, pa.string()), pa.array(copied, pa.int64())],
            ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "n_copied"],
        )

    return by_blocks(run)


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Of each leaf: doc_id, leaf, subroot, root, proof (its siblings, from the lowest up), folded_root, n_copied, verified.

    `leaves` has tree, doc_id (the order), leaf and changed. folded_root is the root of the leaf's version, or of the
    original where nothing was changed; n_copied counts the ancestors copied for the version.
    """
    blocks = grown(numbered(leaves.select("tree", "doc_id", "leaf", "changed"), ["doc_id", "leaf"]), ["doc_id", "changed"], levels)
    tops = reduce(DataFrame.unionByName, (b.where((F.col("block") == 0) & (F.col("total") <= 1 << levels)).select("tree", F.col("root").alias("subroot")) for b in blocks))
    trees = stored(numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf")), ["name"]), "trees")
    forest = grown(trees, [], levels)
    top = forest[-1].where(F.col("block") == 0).select("tree", "block", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), "root")
    last = descended(forest, top, levels).select("tree", "block", "path", "subroot", "root")
    above = forest[0].select("tree", "block", "total", "leaves").join(last, ["tree", "block"]).mapInArrow(
        _paths(levels), f"tree string, subroot string, root string, block long, path {_PATH}"
    )
    start = trees.join(above.select(F.col("block").alias("pos"), "path", "root"), "pos").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("leaf").alias("subroot"), "root"
    )
    paths = descended(blocks, stored(start, "paths"), levels)
    return (
        blocks[0].select("tree", "block", "total", "leaves").join(paths, ["tree", "block"])
        .mapInArrow(_folded(levels), "doc_id long, leaf string, subroot string, root string, proof array<string>, folded_root string, n_copied long")
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
