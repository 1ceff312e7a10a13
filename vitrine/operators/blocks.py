"""Exact top-k of many queries against many items, block by block.

Queries and items are cut into blocks inside each lane (a tenant, or a tenant and a stock switch).
Every (query block, item block) cell is scored in one task with numpy and leaves at most k rows per
query, so no query-item pair is ever shuffled. Block counts follow the counted rows of each lane: a
lane holding a third of all rows is spread over proportionally many cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

RESULT = "lane string, qid string, id string, score double"


def _block_counts(df: DataFrame, key: str, rows: int, name: str) -> DataFrame:
    return df.groupBy("lane").agg(
        F.ceil(F.approx_count_distinct(key) / F.lit(rows)).cast("int").alias(name)
    )


def no_rows(*texts: str, **numbers: type) -> pd.DataFrame:
    """A frame without rows whose columns still have the types that Spark expects."""
    return pd.DataFrame({c: np.empty(0, object) for c in texts} | {c: np.empty(0, kind) for c, kind in numbers.items()})


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id ascending; ``ids`` are ranks of the id order."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= bound)
    else:
        keep = np.arange(len(scores))
    order = np.lexsort((ids[keep], -scores[keep]))
    return keep[order[:k]]


def blocked_top_k(
    queries: DataFrame,
    items: DataFrame,
    score_cell: Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame],
    k: int,
    query_rows: int = 2048,
    item_rows: int = 20_000,
    sized_by: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Best k items per query.

    ``queries`` has ``lane, qid`` and ``items`` has ``lane, id`` plus what ``score_cell`` needs;
    ``score_cell(queries, items, k)`` returns ``lane, qid, id, score`` with its best k per query.
    ``sized_by`` are cheaper tables of the same queries and items to count blocks from.
    """
    # Fresh column identities: both sides may derive from one table.
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    counted_q, counted_i = sized_by or (queries, items)
    q_blocks = _block_counts(counted_q, "qid", query_rows, "q_blocks")
    i_blocks = _block_counts(counted_i, "id", item_rows, "i_blocks")
    sizes = q_blocks.join(i_blocks, "lane")
    spread = lambda count: F.sequence(F.lit(0), count - 1)
    q = (
        queries.join(sizes, "lane")
        .withColumn("q_block", F.pmod(F.xxhash64("qid"), "q_blocks").cast("int"))
        .withColumn("i_block", F.explode(spread(F.col("i_blocks"))))
        .drop("q_blocks", "i_blocks")
    )
    i = (
        items.join(sizes, "lane")
        .withColumn("i_block", F.pmod(F.xxhash64("id"), "i_blocks").cast("int"))
        .withColumn("q_block", F.explode(spread(F.col("q_blocks"))))
        .drop("q_blocks", "i_blocks")
    )
    cell = ["lane", "q_block", "i_block"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return no_rows("lane", "qid", "id", score=float)
        return score_cell(left, right, k)

    # Cells are small in bytes but heavy in work: a stated partition count keeps them apart where
    # size-based coalescing would line them up in one task.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, i = q.repartition(tasks, *cell), i.repartition(tasks, *cell)
    partial = q.groupBy(*cell).cogroup(i.groupBy(*cell)).applyInPandas(run, RESULT)
    return ranked(partial, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """0-based rank per query by score descending, id ascending; k best kept."""
    w = Window.partitionBy("lane", "qid").orderBy(F.desc("score"), "id")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank") - 1)
    )
