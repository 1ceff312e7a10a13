"""Neighbour graph of a catalogue: for every item its nearest others, kept as a table and refined when items are added.

NN-descent. Lanes are cut into cells of like items, several times along other random directions, and the items of a cell are
compared with each other; a lane of one cell is finished by that. Then, round by round, the neighbours of an item
meet each other, as a neighbour of a neighbour is likely to be one: an item's list holds at most k items it points to and k
that point to it, so the work of a round is items x k x k at most, whatever the size of a lane. Only pairs with a link that is new
since the last round are scored. Scores are exact cosines; the graph is approximate in which items it lists.

Scale: in links a number stands for an item. The lists of the items of a cell are looked at in one task, which gets the vector of
each item on them once and returns the best k of each, so a vector is shuffled once a cell and not once a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from vitrine.operators import vector
from vitrine.operators.blocks import no_rows, ranked
from vitrine.operators.inverted_lists import SAMPLE, sampled
from vitrine.session import checkpointed, run_folder

NEIGHBOURS = 40
#: Items of a cell, about, and ways in which a lane is cut into cells.
CELL, CUTTINGS = 8192, 8
#: Items of a cell scored at once against the others.
TILE = 256
#: Found pairs of a cell held before only the best are kept.
HELD = 1 << 21
ROUNDS = 12
#: Share of all links that must be new for another round.
LEAST_NEW = 0.001
LINK = ["item", "other"]
_FOUND = "item long, other long, score double"
#: Scores are compared to six places.
_STEP = 1e-6


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _points(items: DataFrame) -> DataFrame:
    """lane, id, vector and ``item``, a number in the order of lanes and ids."""
    held = items.where("vector is not null").select("lane", "id", "vector").dropDuplicates(["lane", "id"])
    ordered = held.repartitionByRange("lane", "id").sortWithinPartitions("lane", "id")
    return checkpointed(ordered.withColumn("item", F.monotonically_increasing_id()))


def _directions(cutting: int, depth: int, dim: int) -> np.ndarray:
    return np.random.default_rng([cutting, dim]).standard_normal((depth, dim)).T


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _leaf(along: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each row of a binary tree whose cuts are given level by level."""
    leaf = np.zeros(len(along), np.int64)
    for level in range(along.shape[1]):
        leaf = leaf * 2 + (along[:, level] >= cuts[(1 << level) - 1 + leaf])
    return leaf


def _cuttings(points: DataFrame, cell: int) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """For each lane of more than ``cell`` items the cuts of its trees, at medians, and the cells of each leaf.

    Trained in the lane's task on a bounded sample; a leaf with more items than a cell, such as many equal vectors, is several cells.
    What comes back is a number or two a cell.
    """
    large = points.groupBy("lane").agg(F.count("*").alias("lane_size")).where(F.col("lane_size") > cell)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        size, matrix = int(rows["lane_size"].iloc[0]), _unit(rows["vector"])
        depth = int(np.ceil(np.log2(size / cell)))
        trees = []
        for cutting in range(CUTTINGS):
            along = matrix @ _directions(cutting, depth, matrix.shape[1])
            cuts = np.zeros((1 << depth) - 1)
            for level in range(depth):
                leaf, first = _leaf(along[:, :level], cuts), (1 << level) - 1
                for node in np.unique(leaf):
                    cuts[first + node] = np.median(along[leaf == node, level])
            filled = np.bincount(_leaf(along, cuts), minlength=1 << depth)
            trees.append((cuts.tolist(), np.maximum(1, np.ceil(filled / len(rows) * size / cell - 0.25)).astype(int).tolist()))
        return pd.DataFrame({"lane": rows["lane"].iloc[0], "cutting": range(CUTTINGS), "cuts": [t[0] for t in trees], "cells": [t[1] for t in trees]})

    some = sampled(points.join(large.select("lane"), "lane", "left_semi"), SAMPLE).join(large, "lane")
    trees: dict[str, list] = {}
    for row in some.groupBy("lane").applyInPandas(train, "lane string, cutting int, cuts array<double>, cells array<int>").orderBy("lane", "cutting").collect():
        trees.setdefault(row["lane"], []).append((np.array(row["cuts"]), np.array(row["cells"])))
    return trees


def _placed(points: DataFrame, cell: int) -> DataFrame:
    """The points with ``cells``, one of each cutting of their lane, and whether the lane is ``rough``: it has several."""
    trees = _cuttings(points, cell)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cells, rough = np.empty(len(rows), object), np.zeros(len(rows), bool)
            for i in range(len(rows)):
                cells[i] = [0]
            for lane, at in rows.groupby("lane").indices.items():
                if lane not in trees:
                    continue
                matrix, items, own = _unit(rows["vector"].iloc[at]), rows["item"].to_numpy()[at], []
                for cutting, (cuts, leaf_cells) in enumerate(trees[lane]):
                    leaf = _leaf(matrix @ _directions(cutting, int(np.log2(len(leaf_cells))), matrix.shape[1]), cuts)
                    part = (_mixed(items.astype(np.uint64) + np.uint64(cutting << 57)) % leaf_cells[leaf].astype(np.uint64)).astype(np.int64)
                    own.append((cutting << 52) + (leaf << 26) + part)
                rough[at] = True
                for i, row in zip(at, np.stack(own, axis=1), strict=True):
                    cells[i] = row
            yield rows.assign(cells=cells, rough=rough)

    return points.mapInPandas(place, points.select("*", F.array(F.lit(0).cast("long")).alias("cells"), F.lit(True).alias("rough")).schema)


def _kept(item: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's k best, a pair once, equal scores by the other's place."""
    order = np.lexsort((other, -score, item))
    item, other, score = item[order], other[order], score[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (other[1:] != other[:-1]) | (score[1:] != score[:-1])
    item, other, score = item[new], other[new], score[new]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    return tuple(x[rank < k] for x in (item, other, score))


def _beside(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The best of each item of a cell among the others of it; with ``added`` items only pairs with one of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        unit, items, added = _unit(rows["vector"]), rows["item"].to_numpy(), rows["added"].to_numpy()
        out = []
        if added.any():
            for at in range(0, len(rows), TILE):
                score = unit[at : at + TILE] @ unit.T
                own = np.arange(len(score))
                score[own, at + own] = -np.inf
                if not added.all():
                    score[~(added[at : at + TILE, None] | added[None, :])] = -np.inf
                bound = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(score), -2.0)
                a, b = np.nonzero(score >= np.maximum(bound, -2.0)[:, None] - _STEP)
                out.append(_kept(at + a, b, np.round(score[a, b], 6), k))
        if not out:
            return no_rows(item=np.int64, other=np.int64, score=float)
        a, b, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"item": items[a], "other": items[b], "score": score})

    return run


def _first_links(placed: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """Links between items of a cell; with ``only(lane, id)`` those of its items."""
    if only is None:
        marked = placed.withColumn("added", F.lit(True))
    else:
        marked = placed.join(only.select("lane", "id", F.lit(True).alias("added")).distinct(), ["lane", "id"], "left").withColumn("added", F.coalesce("added", F.lit(False)))
    dealt = marked.select("lane", "item", "vector", "added", F.explode("cells").alias("cell"))
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "lane", "cell").groupBy("lane", "cell").applyInPandas(_beside(k), _FOUND)


def _best(links: DataFrame, k: int) -> DataFrame:
    """``(item, other, score, fresh)``: each item's k best; a link is fresh if no row of it is old."""
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = links.repartition(tasks, "item").groupBy(*LINK).agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "other")
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _meet(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores of the pairs of a list of which one link is new, where they may enter the list of the pair's first item.

    ``left(hub, member, fresh)`` are the lists of a cell, ``right(member, vector, bound)`` all items on them.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return no_rows(item=np.int64, other=np.int64, score=float)
        right, left = right.sort_values("member"), left.sort_values("hub")
        items, unit, bound = right["member"].to_numpy(), _unit(right["vector"]), right["bound"].to_numpy()
        member, fresh, hub = np.searchsorted(items, left["member"].to_numpy()), left["fresh"].to_numpy(), left["hub"].to_numpy()
        edges = [0, *(np.flatnonzero(hub[1:] != hub[:-1]) + 1).tolist(), len(hub)]
        held, size = [], 0
        for lo, hi in zip(edges, edges[1:], strict=False):
            own, new = member[lo:hi], fresh[lo:hi]
            score = np.round(unit[own] @ unit[own].T, 6)
            enters = (new[:, None] | new[None, :]) & (score >= bound[own][:, None])
            np.fill_diagonal(enters, False)
            a, b = np.nonzero(enters)
            held.append((own[a], own[b], score[a, b]))
            size += len(a)
            if size > HELD:
                held = [_kept(*(np.concatenate(x) for x in zip(*held, strict=True)), k)]
                size = 0
        a, b, score = _kept(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
        return pd.DataFrame({"item": items[a], "other": items[b], "score": score})

    return run


def _descend(placed: DataFrame, links: DataFrame, k: int) -> DataFrame:
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = placed.where("rough").select(F.col("item").alias("hub"), F.col("lane").alias("hub_lane"), F.col("cells")[0].alias("cell"))
    for number in range(ROUNDS):
        total, new = links.agg(F.count("*"), F.count_if("fresh")).first()
        if new <= LEAST_NEW * total:
            break
        bounds = links.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        known = placed.where("rough").select("item", "vector").join(bounds, "item", "left").select(
            F.col("item").alias("member"), "vector", F.coalesce("bound", F.lit(-2.0)).alias("bound")
        )
        # of the links to an item k are taken, new ones first, others every round
        towards = Window.partitionBy("other").orderBy(F.desc("fresh"), F.xxhash64(F.lit(number), "item"), "item")
        backward = links.withColumn("n", F.row_number().over(towards)).where(F.col("n") <= k)
        listed = links.select(F.col("item").alias("hub"), F.col("other").alias("member"), "fresh").unionByName(
            backward.select(F.col("other").alias("hub"), F.col("item").alias("member"), "fresh")
        ).repartition(tasks, "hub").groupBy("hub", "member").agg(F.max("fresh").alias("fresh"))
        fresh = links.where("fresh")
        live = fresh.select(F.col("item").alias("hub")).unionByName(fresh.select(F.col("other").alias("hub"))).distinct()
        # read twice: the lists, and which items are on those of a cell
        lists = checkpointed(listed.join(live, "hub", "left_semi").join(cells, "hub"))
        cell = ["hub_lane", "cell"]
        # fresh column identities: both sides come from the lists
        members = lists.select(*[F.col(c).alias(c) for c in [*cell, "member"]]).distinct().join(known, "member").select(*[F.col(c).alias(c) for c in [*cell, "member", "vector", "bound"]])
        found = lists.repartition(tasks, *cell).groupBy(*cell).cogroup(members.repartition(tasks, *cell).groupBy(*cell)).applyInPandas(_meet(k), _FOUND)
        links = checkpointed(_best(links.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), k))
    return links


def _refined(placed: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """``(lane, id, other, score)`` from the first links: lanes of one cell are done, the others descend."""
    lanes = placed.select("item", "rough")
    links = checkpointed(_best(links, k).join(lanes, "item"))
    done = links.where("not rough").select(*LINK, "score")
    if not links.where("rough").isEmpty():
        done = done.unionByName(_descend(placed, links.where("rough").drop("rough"), k).select(*LINK, "score"))
    names = placed.select("item", "lane", "id")
    others = placed.select(F.col("item").alias("other"), F.col("id").alias("other_id"))
    return done.join(names, "item").join(others, "other").select("lane", "id", F.col("other_id").alias("other"), "score")


def _written(graph: DataFrame, folder: str | None) -> DataFrame:
    spark = graph.sparkSession
    folder = folder or run_folder(spark, "neighbour-graph")
    graph.write.mode("errorifexists").parquet(folder)
    return spark.read.parquet(folder)


def build(items: DataFrame, k: int = NEIGHBOURS, folder: str | None = None, cell: int = CELL) -> DataFrame:
    """``(lane, id, other, score)``: about the k nearest others of each of ``items(lane, id, vector)``, written once.

    Items without a vector are not in the graph; of rows that repeat an id one counts; a vector without length is as near to all.
    """
    placed = checkpointed(_placed(_points(items), cell))
    return _written(_refined(placed, _first_links(placed, k).withColumn("fresh", F.lit(True)), k), folder)


def extended(graph: DataFrame, items: DataFrame, added: DataFrame, k: int = NEIGHBOURS, folder: str | None = None, cell: int = CELL) -> DataFrame:
    """The graph with ``added(lane, id)``, which are among ``items``; only lists that a new link reaches are looked at again."""
    placed = checkpointed(_placed(_points(items), cell))
    names = placed.select("lane", "id", "item")
    kept = graph.join(names, ["lane", "id"]).drop("id").join(names.withColumnsRenamed({"id": "other", "item": "other_item"}), ["lane", "other"])
    old = kept.select("item", F.col("other_item").alias("other"), "score", F.lit(False).alias("fresh"))
    return _written(_refined(placed, _first_links(placed, k, added).withColumn("fresh", F.lit(True)).unionByName(old), k), folder)


def nearest(sources: DataFrame, items: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """k nearest ``items(lane, id, vector)`` of ``sources(lane, qid, self_id, vector)``, read from the graph.

    Items may be fewer than those of the graph (what is on sale now). A source that the graph does not know, or of whose
    list fewer than k are left, is searched exactly.
    """
    allowed = items.select("lane", F.col("id").alias("other")).distinct()
    held = graph.join(allowed, ["lane", "other"], "left_semi")
    asked = sources.select("lane", "qid", F.col("self_id").alias("id"))
    listed = checkpointed(ranked(asked.join(held, ["lane", "id"]).select("lane", "qid", F.col("other").alias("id"), "score"), k))
    enough = listed.groupBy("lane", "qid").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    rest = vector.nearest(sources.join(enough, ["lane", "qid"], "left_anti"), items, k)
    return listed.join(enough, ["lane", "qid"], "left_semi").unionByName(rest)
