"""Inverted lists of vectors: approximate nearest items, and exact ones with whole lists left out.

Items of a lane are dealt to the lists of their nearest centroid. An approximate search opens the lists
nearest to a query, ranks their items by product-quantised residuals, a few bytes an item, and
re-ranks the best of them with the whole vectors. An exact search takes a first threshold from the nearest
lists and then opens only those whose bound, from centroid and radius, can still beat it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.operators import vector
from vitrine.operators.blocks import best_rows, blocked_top_k, no_rows, ranked
from vitrine.session import checkpointed, run_folder, written

POOL = 80
#: Vectors of a lane, and of all lanes for the codes, that training looks at; every item is indexed.
SAMPLE = 20_000
#: Lists of a lane at most; a lane has about the square root of its items.
MAX_LISTS = 4096
#: Items of a block when items are dealt to lists.
BLOCK_ROWS = 50_000
#: Queries of a block when they meet centroids.
QUERY_ROWS = 2048
CODE_WORDS = 256
ROUNDS = 12


@dataclass
class VectorLists:
    items: DataFrame  # lane, list, id, vector, code
    lists: DataFrame  # lane, list, centroid, radius (angle), size
    codebook: np.ndarray  # parts x words x dimensions of a part; its size does not depend on the data


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def spherical_means(rows: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; seeds are rows far from those already taken, empty lists keep theirs."""
    rng = np.random.default_rng(seed)
    n = min(n, len(rows))
    means = rows[rng.choice(len(rows), n, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(rows[at : at + 4096] @ means.T).argmax(axis=1) for at in range(0, len(rows), 4096)])
        sums = np.zeros_like(means)
        np.add.at(sums, own, rows)
        filled = np.bincount(own, minlength=n) > 0
        means[filled] = _unit(sums[filled])
        if (~filled).any():  # an empty list restarts at the rows farthest from their centroids
            far = np.argsort(np.einsum("ij,ij->i", rows, means[own]))[: int((~filled).sum())]
            means[~filled] = rows[far]
    return means


def _words(rows: np.ndarray, words: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Plain k-means of short rows."""
    rng = np.random.default_rng(seed)
    means = rows[rng.choice(len(rows), min(words, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest_word(rows, means)
        count = np.bincount(own, minlength=len(means))
        for d in range(rows.shape[1]):
            means[:, d] = np.where(count > 0, np.bincount(own, rows[:, d], len(means)) / np.maximum(count, 1), means[:, d])
    return means


def _nearest_word(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = (words * words).sum(axis=1) / 2
    return np.concatenate([(rows[at : at + 4096] @ words.T - half).argmax(axis=1) for at in range(0, max(len(rows), 1), 4096)])


def _parts(dim: int) -> int:
    """Parts of four dimensions where that divides, else of one."""
    return dim // 4 if dim % 4 == 0 else dim


def sampled(items: DataFrame, rows: int) -> DataFrame:
    """At most `rows` items of each lane, the same ones every time."""
    w = Window.partitionBy("lane").orderBy(F.xxhash64("id"), "id")
    return items.select("lane", "vector", F.row_number().over(w).alias("n"), F.col("id")).filter(F.col("n") <= rows).select("lane", "vector")


def build(items: DataFrame, sample: int = SAMPLE, folder: str | None = None) -> VectorLists:
    """Lists over ``items(lane, id, vector)``, trained on a bounded sample and written once.

    Centroids are trained per lane, in the lane's task, on at most ``sample`` vectors; codes on at most
    ``sample`` vectors of all lanes, on the driver.
    """
    spark = items.sparkSession
    folder = folder or run_folder(spark, "vector-lists")
    sizes = items.groupBy("lane").agg(F.count("*").alias("lane_size"))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        n = min(MAX_LISTS, max(1, round(rows["lane_size"].iloc[0] ** 0.5)))
        means = spherical_means(_unit(_matrix(rows["vector"])), n)
        return pd.DataFrame({"lane": rows["lane"].iloc[0], "list": np.arange(len(means)), "centroid": list(means)})

    sampled(items, sample).join(sizes, "lane").groupBy("lane").applyInPandas(train, "lane string, list int, centroid array<double>").write.mode("overwrite").parquet(f"{folder}/centroids")
    centroids = spark.read.parquet(f"{folder}/centroids")
    blocks = sizes.select("lane", F.ceil(F.col("lane_size") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = items.select("lane", "id", "vector").join(blocks, "lane").select("lane", "id", "vector", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    spread = centroids.join(blocks, "lane").select("lane", "list", "centroid", F.explode(_numbers(F.col("blocks"))).alias("block"))

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return no_rows("lane", "id", "vector", list=int, near=float)
        rows, means = _unit(_matrix(left["vector"])), _matrix(right["centroid"])
        closest = np.concatenate([(rows[at : at + 4096] @ means.T).argmax(axis=1) for at in range(0, len(rows), 4096)])
        near = np.einsum("ij,ij->i", rows, means[closest])
        return pd.DataFrame({"lane": left["lane"], "list": right["list"].to_numpy()[closest], "id": left["id"], "vector": left["vector"], "near": near})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = ["lane", "block"]
    placed = dealt.repartition(tasks, *cell).groupBy(*cell).cogroup(spread.repartition(tasks, *cell).groupBy(*cell)).applyInPandas(
        assign, "lane string, list int, id string, vector array<double>, near double"
    )
    placed.write.mode("overwrite").parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    radius = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("near"))))
    lists = centroids.join(placed.groupBy("lane", "list").agg(radius.alias("radius"), F.count("*").alias("size")), ["lane", "list"])
    lists.write.mode("overwrite").parquet(f"{folder}/lists")
    lists = spark.read.parquet(f"{folder}/lists")

    some = placed.orderBy(F.xxhash64("lane", "id"), "lane", "id").limit(sample).join(centroids, ["lane", "list"]).select("vector", "centroid").toPandas()
    if some.empty:
        codebook = np.zeros((1, 1, 1))
    else:
        left = _unit(_matrix(some["vector"])) - _matrix(some["centroid"])
        codebook = np.stack([_words(part, CODE_WORDS) for part in np.split(left, _parts(left.shape[1]), axis=1)])

    def encode(batches):
        for rows in batches:
            if len(rows):
                rest = _unit(_matrix(rows["vector"])) - _matrix(rows["centroid"])
                codes = np.stack([_nearest_word(part, words) for part, words in zip(np.split(rest, len(codebook), axis=1), codebook, strict=True)], axis=1)
                yield rows.drop(columns="centroid").assign(code=[c.tobytes() for c in codes.astype(np.uint8)])

    coded = placed.select("lane", "list", "id", "vector").join(centroids, ["lane", "list"]).mapInPandas(
        encode, "lane string, list int, id string, vector array<double>, code binary"
    )
    coded.write.mode("overwrite").partitionBy("lane").parquet(f"{folder}/items")
    kept = spark.read.schema("list int, id string, vector array<double>, code binary, lane string").parquet(f"{folder}/items")
    return VectorLists(kept.select("lane", "list", "id", "vector", "code"), lists, codebook)


def _numbers(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)


def _cell(lane: Column, number: Column) -> Column:
    return F.concat(lane, F.lit("#"), number.cast("string"))


def _uncell(found: DataFrame) -> DataFrame:
    return found.withColumn("lane", F.regexp_replace("lane", "#[0-9]+$", ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine to six places; zero where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.round(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0)), 6)


def _open(queries: DataFrame, index: VectorLists, choose: Callable[[np.ndarray, np.ndarray, np.ndarray, pd.Series], np.ndarray]) -> DataFrame:
    """``(lane, qid, list, near)``: the lists that each query opens, with the cosine to their centroid.

    Queries meet the lists of their lane in blocks of ``QUERY_ROWS``. ``choose`` gets the cosines, radii and sizes of
    the lists, nearest first, and the query's row, and returns which ones are opened.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = queries.groupBy("lane").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    left = queries.join(blocks, "lane").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks")).drop("blocks")
    right = index.lists.join(blocks, "lane").withColumn("block", F.explode(_numbers(F.col("blocks")))).drop("blocks")

    def run(asked: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or lists.empty:
            return no_rows("lane", "qid", list=int, near=float)
        lists = lists.sort_values("list")
        numbers, radius, size = (lists[c].to_numpy() for c in ("list", "radius", "size"))
        near = _unit(_matrix(asked["vector"])) @ _matrix(lists["centroid"]).T
        chosen = []
        for n in range(len(asked)):
            order = np.argsort(-near[n], kind="stable")
            chosen.append(order[choose(near[n][order], radius[order], size[order], asked.iloc[n])])
        row, at = np.repeat(np.arange(len(asked)), [len(c) for c in chosen]), np.concatenate(chosen)
        return pd.DataFrame({"lane": asked["lane"].to_numpy()[row], "qid": asked["qid"].to_numpy()[row], "list": numbers[at], "near": near[row, at]})

    cell = ["lane", "block"]
    return left.repartition(tasks, *cell).groupBy(*cell).cogroup(right.repartition(tasks, *cell).groupBy(*cell)).applyInPandas(
        run, "lane string, qid string, list int, near double"
    )


def _code_cell(codebook: np.ndarray):
    """Approximate scores of a list's items: the query's product with the centroid and with the coded residual."""

    def run(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
        ids = right["id"].to_numpy()
        order = np.argsort(np.argsort(ids))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in right["code"]])
        queries = _unit(_matrix(left["vector"]))
        parts = queries.reshape(len(queries), len(codebook), -1)
        chosen, scores = [], []
        for n in range(len(left)):
            table = np.einsum("md,mwd->mw", parts[n], codebook)
            score = np.round(left["base"].iat[n] + table[np.arange(len(codebook)), codes].sum(axis=1), 6)
            chosen.append(best_rows(score, order, k))
            scores.append(score[chosen[-1]])
        row, at = np.repeat(np.arange(len(left)), [len(c) for c in chosen]), np.concatenate(chosen)
        return pd.DataFrame({"lane": left["lane"].iloc[0], "qid": left["qid"].to_numpy()[row], "id": ids[at], "score": np.concatenate(scores)})

    return run


def _asked(opened: DataFrame, queries: DataFrame) -> DataFrame:
    return opened.join(queries, ["lane", "qid"]).select(_cell(F.col("lane"), F.col("list")).alias("lane"), "qid", "vector", F.col("near").alias("base"))


def nearest_approx(queries: DataFrame, index: VectorLists, k: int = POOL, share: float = 0.1, rerank: int = 4) -> DataFrame:
    """Approximate k nearest of ``queries(lane, qid, vector)``.

    Opens a query's nearest lists until they hold ``share`` of its lane's items (and ``rerank`` x k items),
    ranks their items by code and scores the best ``rerank`` x k with their whole vectors.
    """

    def choose(near, radius, size, row):
        return np.cumsum(size) - size < max(share * size.sum(), rerank * k)

    held = index.items.select(_cell(F.col("lane"), F.col("list")).alias("lane"), "id", "code")
    rough = blocked_top_k(_asked(_open(queries, index, choose), queries), held, _code_cell(index.codebook), rerank * k)
    candidates = ranked(_uncell(rough).drop("rank"), rerank * k).select("lane", "qid", "id")
    items = index.items.select("lane", "id", F.col("vector").alias("item"))
    scored = candidates.join(items, ["lane", "id"]).join(queries, ["lane", "qid"]).select("lane", "qid", "id", cosine(F.col("vector"), F.col("item")).alias("score"))
    return ranked(scored, k)


def nearest_pruned(queries: DataFrame, index: VectorLists, k: int = POOL) -> tuple[DataFrame, DataFrame]:
    """Exact k nearest, and ``(lane, qid, lists, opened)``: how many of a query's lists were scored.

    The cosine with an item of a list is at most that of the angle to its centroid less its radius. The
    nearest lists that hold k items give a first k-th score; of the others only those whose bound reaches it are opened.
    """
    queries = written(queries, "vector-queries")  # they meet centroids and items twice each
    held = index.items.select(_cell(F.col("lane"), F.col("list")).alias("lane"), "id", "vector")

    def first(near, radius, size, row):
        return np.cumsum(size) - size < k

    def rest(near, radius, size, row):
        angle = np.maximum(0.0, np.arccos(np.clip(near, -1.0, 1.0)) - radius)
        # scores are compared to six places; a query without length is as near to every list
        return ~first(near, radius, size, row) & ((row["found"] < k) | (np.cos(angle) >= row["kth"] - 2e-6) | ~np.any(row["vector"]))

    def scored(opened: DataFrame) -> DataFrame:
        return _uncell(blocked_top_k(_asked(opened, queries).drop("base"), held, vector.cosine_cell, k, item_rows=BLOCK_ROWS)).drop("rank")

    # both are read twice; a query's lists, and its best k
    opened = checkpointed(_open(queries, index, first))
    begun = checkpointed(ranked(scored(opened), k).drop("rank"))
    bound = begun.groupBy("lane", "qid").agg(F.min("score").alias("kth"), F.count("*").alias("found"))
    more = checkpointed(_open(queries.join(bound, ["lane", "qid"]), index, rest))
    report = (
        opened.unionByName(more).groupBy("lane", "qid").agg(F.count("*").alias("opened"))
        .join(index.lists.groupBy("lane").agg(F.count("*").alias("lists")), "lane").select("lane", "qid", "lists", "opened")
    )
    return ranked(begun.unionByName(scored(more)), k), report
