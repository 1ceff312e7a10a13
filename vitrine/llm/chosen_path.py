"""Similarity join of texts on five-word shingles by chosen paths.

Texts with equal shingle sets are one node. A node's set is embedded as `WIDTH` MinHash values; two sets share a value
with the probability of their Jaccard similarity. A run of the join is a tree: at every inner tree node positions are sampled, the same
for all sets there, with probability 1 / (threshold x WIDTH) each, and a set goes to one child per sampled position, named by
its value. Sets that are alone in a child leave the tree, buckets of at most `BUCKET` sets are compared by brute force,
larger ones are split again; what is still larger at the last level is compared in blocks of that size, pair by pair of blocks. Runs are
repeated with other samples until a pair at the threshold has been in a common bucket with `recall` at least. The root's samples are
known beforehand, so a run whose root samples nothing is skipped.

Sets whose embeddings agree enough are candidates. Candidate links are gathered to components, and inside a component
all texts are compared exactly on their whole shingle sets, again in blocks, so that every link is found once and
counted, never listed: a row per text and block leaves the task, not a row per pair. Classes are the components of exact links.

A text of one to four words has one shingle of all its words. A null text or one without words has no set: it is a class of its own,
without links. Rows that repeat are copies of one text. A null id can be in a class; a class is named by its smallest id.
Extra columns are not read. Copies of one text are aggregated on the map side and never meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.llm.common import by_batch, groups, stored, texts, whole_rows
from vitrine.llm.wordtape import mixed, ranges, rolling, slices, tape

SHINGLE = 5
THRESHOLD = 0.8
WIDTH = 64
#: Sets of a bucket or block that are compared by brute force.
BUCKET = 512
#: Levels of a tree. Sets that share a third of their values or less have left each other by then (at most (1/3 / 0.8)^4); more levels would
#: only copy groups of near copies, which no level can part and which are compared in blocks in the end.
DEPTH = 4
RECALL = 0.99
#: Parts in which the links of one member are looked at.
SALTS = 64
#: Standard deviations below the threshold at which an embedding still makes a candidate.
SLACK = 3.5

_RANDOM = np.random.default_rng(58)
_FACTORS = _RANDOM.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def survival(threshold: float, levels: int) -> float:
    """Share of the pairs at the threshold, together in a tree node, that are still together in a node `levels` deeper.

    Each of a node's WIDTH positions is sampled with 1 / (threshold x WIDTH) and, where it is, keeps the pair together with
    probability `threshold`.
    """
    share = 1.0
    for _ in range(levels):
        share = 1 - (1 - share / WIDTH) ** WIDTH
    return share


def root_samples(threshold: float = THRESHOLD, recall: float = RECALL, levels: int = DEPTH - 1) -> list[tuple[int, int]]:
    """(run, position) of the roots, runs being added until a pair at the threshold is missed with 1 - recall at most.

    That holds also where all its buckets are large down to the last of `levels` below the root. The paths of a run
    are taken to end together, which they do less often than that.
    """
    rng, out, run, miss = np.random.default_rng(41), [], 0, 1.0
    deeper = survival(threshold, levels)
    while miss > 1 - recall:
        chosen = np.flatnonzero(rng.random(WIDTH) < 1 / (threshold * WIDTH)).tolist()
        if chosen:
            out += [(run, p) for p in chosen]
            miss *= 1 - (1 - (1 - threshold) ** len(chosen)) * deeper
        run += 1
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all distinct shingles, sorted by text; 44 bits of the hash, and the text's number above them."""
    words = tape(data, offsets)
    hashes = words.hashes()
    count = np.diff(words.first)
    n = np.maximum(count - size + 1, 0)
    each = rolling(hashes, size)[ranges(words.first[:-1], n)] if n.any() else np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(count)), n)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.array([rolling(hashes[words.first[i] : words.first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        each, text = np.concatenate([each, own]), np.concatenate([text, short])
    joined = np.unique((text.astype(np.uint64) << np.uint64(44)) | (each >> np.uint64(20)))
    return (joined >> np.uint64(44)).astype(np.int64), joined & np.uint64((1 << 44) - 1)


def _embed(batch: pa.RecordBatch) -> pa.RecordBatch:
    nodes: list[bytes | None] = []
    sketches: list[bytes | None] = []
    for lo, hi, data, offsets in slices(batch.column("text")):
        text, each = shingles(data, offsets)
        own: list[bytes | None] = [None] * (hi - lo)
        sketch: list[bytes | None] = [None] * (hi - lo)
        if len(text):
            begins = np.flatnonzero(np.diff(text, prepend=-1))
            strong = mixed(each + np.uint64(1))
            key = np.stack([np.add.reduceat(strong, begins), np.add.reduceat(mixed(strong + np.uint64(0x5851F42D4C957F2D)), begins)], 1)
            least = np.empty((len(begins), WIDTH), np.uint64)
            for k, factor in enumerate(_FACTORS):
                least[:, k] = np.minimum.reduceat(strong * factor, begins)
            values = (mixed(least) >> np.uint64(32)).astype(">u4")
            for row, i in enumerate(text[begins].tolist()):
                own[i], sketch[i] = key[row].tobytes(), values[row].tobytes()
        nodes += own
        sketches += sketch
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("mark"), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "mark", "node", "sketch"]
    )


def _value(sketch: Column, position: Column | int) -> Column:
    return F.substring(sketch, F.lit(position) * 4 + 1 if isinstance(position, int) else position * 4 + 1, F.lit(4))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with the lower halves of their values, which are all that candidates are told by."""
    for batch in batches:
        halves = [np.frombuffer(s, ">u4").astype(">u2").tobytes() for s in batch.column("sketch").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(halves, pa.binary())], ["node", "sketch"])


def _shared(paths: DataFrame) -> DataFrame:
    """(path, node, n) of the buckets that hold several nodes."""
    # written first: a join of two exchanges is one whose hot keys Spark can split
    sizes = stored(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
    return paths.join(sizes, "path")


def _forest(linked: list[np.ndarray]) -> np.ndarray:
    """Root (smallest member) of each item, from the items linked to each."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i], queue = i, [i]
            while queue:
                for j in linked[queue.pop()].tolist():
                    if root[j] < 0:
                        root[j] = i
                        queue.append(j)
    return root


def _stars(linked: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) of a few links that connect what `linked` connects: to the first member of each connected part.

    Of a pair of blocks, only what joins a part of one block to a part of the other: either block's own links are found
    where it meets itself, so a group of many blocks has a link a member and one a pair of blocks.
    """
    root = _forest([np.flatnonzero(row) for row in linked])
    heads = np.arange(len(root))
    if side.any() and not side.all():
        own = _forest([np.flatnonzero(row & (side == s)) for row, s in zip(linked, side, strict=True)])
        heads = np.flatnonzero(own == heads)
    return [(i, r) for i, r in zip(heads.tolist(), root[heads].tolist(), strict=True) if r != i]


def _candidates(least: int):
    """Links inside buckets, as stars around the first member of each connected part. Of a pair of blocks, see `_stars`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[bytes] = []
        roots: list[bytes] = []
        for bucket in groups(batches, "key"):
            nodes = bucket.column("node").to_pylist()
            values = np.frombuffer(b"".join(bucket.column("sketch").to_pylist()), ">u2").reshape(len(nodes), WIDTH)
            side = bucket.column("side").to_numpy() if "side" in bucket.column_names else np.zeros(len(nodes), np.int32)
            if len(nodes) == 2:
                links = [(1, 0)] if (values[0] == values[1]).sum() >= least else []
            else:
                links = _stars(np.stack([(values == v).sum(1) >= least for v in values]), side)
            for i, r in links:
                if nodes[i] != nodes[r]:
                    names.append(nodes[i])
                    roots.append(nodes[r])
            if len(names) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(roots, pa.binary())], ["a", "b"])
                names, roots = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(roots, pa.binary())], ["a", "b"])

    return run


def _dealt(rows: DataFrame, bucket: str, size: int) -> DataFrame:
    """Rows of (bucket, node, n, ...) under keys of bounded size: a bucket, or a pair of blocks of a larger one."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("side", (F.col("own") == high).cast("int")).withColumn("pair", low != high).withColumn("key", F.xxhash64(bucket, low, high)).drop("other")


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with m, the smallest b of their a. A member with very many links is as many keys as there are salts."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    # a member has at most as many parts as there are salts
    least = parts.select("a", "salt", F.min("m").over(Window.partitionBy("a")).alias("m"))
    return salted.join(least, ["a", "salt"]).select("a", "b", "m")


def _pair(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links (a, b), b < a, turned to the smallest b of their a."""
    after = _with_least(links).select(F.inline(F.array_compact(F.array(_pair("a", "m"), F.when(F.col("b") != F.col("m"), _pair("b", "m"))))))
    return stored(after.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): the smallest node it is connected with, by alternating stars.

    Each round links larger neighbours to the smallest, then smaller ones; it ends when no link changes. Both halves of a
    round are written, so a plan holds one star only: the driver keeps the plans of all rounds. Smaller ones are linked once
    beforehand: a node with links to many roots comes into the rounds with one of its own.
    """
    turned = F.col("a") > F.col("b")
    hi, lo = F.when(turned, F.col("a")).otherwise(F.col("b")), F.when(turned, F.col("b")).otherwise(F.col("a"))
    links = _small_star(stored(edges.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct()))
    state = None
    while True:
        both = links.select(F.inline(F.array(_pair("a", "b"), _pair("b", "a"))))
        large = stored(_with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        links = _small_star(large)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _exact(ratio: tuple[int, int]):
    """Links of whole shingle sets inside a key; per text the copies it is linked with, and the first text of its part.

    Similarity at least p / q: (p + q) x shared >= p x (sum of both sizes).
    """
    p, q = ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches, "key"):
            bucket = bucket.combine_chunks()
            nodes = bucket.column("node").to_pylist()
            sets, each = [], []
            done = 0
            for lo, hi, data, offsets in slices(bucket.column("text").chunk(0)):
                text, values = shingles(data, offsets)
                sets.append(text + done)
                each.append(values)
                done += hi - lo
            text, values = np.concatenate(sets), np.concatenate(each)
            if len(nodes) < 2 or not len(text):
                continue
            order = np.argsort(values, kind="stable")
            number = np.empty(len(values), np.int64)
            number[order] = np.cumsum(np.diff(values[order], prepend=values[order[0]]) != 0)
            holders = text[order]  # texts that hold shingle k: holders[first[k]:first[k + 1]]
            first = np.append(np.flatnonzero(np.diff(number[order], prepend=-1)), len(order))
            size = np.bincount(text, minlength=len(nodes))
            begin = np.cumsum(size) - size
            copies = bucket.column("copies").to_numpy()
            side, pair = bucket.column("side").to_numpy(), bucket.column("pair").to_numpy()[0]
            linked, weight = [], np.zeros(len(nodes), np.int64)
            for i in range(len(nodes)):
                own = number[begin[i] : begin[i] + size[i]]
                shared = np.bincount(holders[ranges(first[own], first[own + 1] - first[own])], minlength=len(nodes))
                near = (p + q) * shared >= p * (size + size[i])
                near[i] = False
                if pair:
                    near &= side != side[i]
                partners = np.flatnonzero(near)
                linked.append(partners)
                weight[i] = copies[partners].sum()
            root = _forest(linked)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(weight), pa.array([nodes[r] for r in root.tolist()], pa.binary())], ["a", "n", "b"])

    return run


def classes(docs: DataFrame, threshold: tuple[int, int] = (4, 5), bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id, n_links, class_docs, class_key, mark: one row a document.

    n_links counts the other documents at the threshold (a fraction p / q) or above, copies included; class_docs the
    documents of the class. class_key tells classes apart also where ids are null; mark is a hash of the text.
    """
    bound = threshold[0] / threshold[1]
    source = texts(docs).withColumn("mark", F.xxhash64("text"))
    rows = stored(source.mapInArrow(by_batch(_embed), "doc_id long, mark long, node binary, sketch binary"))
    nodes = stored(
        rows.where("node is not null").groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "mark")).alias("one"), F.min("sketch").alias("sketch"))
    )
    level = nodes.select("node", F.explode(F.array(*(F.xxhash64(F.lit(run), F.lit(p), _value(F.col("sketch"), p)) for run, p in root_samples(bound, levels=depth - 1)))).alias("path"))
    leaves: list[DataFrame] = []
    for step in range(depth):
        found = stored(_shared(level))
        last = step == depth - 1 or found.where(F.col("n") > bucket).isEmpty()
        leaves.append(found if last else found.where(F.col("n") <= bucket))
        if last:
            break
        # the sampled positions depend on the tree node alone
        positions = F.array(*(F.when(F.pmod(F.xxhash64("path", F.lit(k)), F.lit(1 << 20)) < F.lit(int((1 << 20) / (bound * WIDTH))), F.lit(k)) for k in range(WIDTH)))
        large = found.where(F.col("n") > bucket).join(nodes.select("node", "sketch"), "node")
        level = stored(large.select("node", "sketch", "path", F.explode(F.filter(positions, lambda k: k.isNotNull())).alias("k")).select(
            "node", F.xxhash64("path", "k", _value(F.col("sketch"), F.col("k"))).alias("path")
        ))
    rest = leaves[0]
    for leaf in leaves[1:]:
        rest = rest.unionByName(leaf)
    least = math.ceil(WIDTH * (bound - SLACK * math.sqrt(bound * (1 - bound) / WIDTH)))
    edges = (
        # a large bucket's sketches are dealt once a pair of blocks: half of each suffices
        _dealt(rest, "path", bucket).select("key", "node", "side").join(nodes.select("node", "sketch").mapInArrow(_short, "node binary, sketch binary"), "node")
        # in order of nodes, so that a group's first member is the same in many buckets and its links repeat
        .repartition("key").sortWithinPartitions("key", "node").mapInArrow(_candidates(least), "a binary, b binary")
    )
    grouped = components(edges)
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n"))
    members = grouped.join(sizes, "root").join(nodes.drop("sketch"), "node").select("node", "root", "n", "copies", F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("_mark"))
    matched = members.join(source, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).dropDuplicates(["node"])
    compared = stored(
        _dealt(matched.select("root", "node", "n", "copies", "text"), "root", bucket).select("key", "node", "copies", "side", "pair", "text")
        .repartition("key").sortWithinPartitions("key").mapInArrow(_exact(threshold), "a binary, n long, b binary")
    )
    links = compared.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = components(compared.select("a", "b")).withColumnRenamed("root", "class_key")
    placed = (
        nodes.select("node", "copies", "least_id").join(named, "node", "left").join(links, "node", "left")
        .select("node", "copies", "least_id", F.coalesce("class_key", "node").alias("class_key"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    heads = placed.groupBy("class_key").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_docs"))
    info = placed.join(heads, "class_key").select("node", "class_key", "class_id", "class_docs", "n_links")
    return rows.drop("sketch").join(info, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_docs", F.lit(1)).cast("long").alias("class_docs"), "class_key", "mark",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of the smallest id of each class, with all its columns. Texts without words all stay.

    Of rows that repeat its id and text, the one stays whose other columns come first as JSON text.
    """
    found = classes(docs).where("class_key is not null")
    kept = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("k")).select(F.col("k.doc_id").alias("hit_id"), F.col("k.mark").alias("hit_mark"))
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    others = F.to_json(F.struct(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text"))))
    repeat = F.row_number().over(Window.partitionBy("own_id", "own_mark").orderBy("others"))
    first = (
        whole_rows(docs.where(worded)).join(kept, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_mark") == F.col("hit_mark")), "left_semi")
        .withColumn("others", others).withColumn("repeat", repeat).where("repeat = 1")
    )
    return first.select("row.*").unionByName(docs.where(~worded))
