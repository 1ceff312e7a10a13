"""Vector retrieval: exact nearest items; see `inverted_lists` for approximate and pruned search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vitrine.operators.blocks import best_rows, blocked_top_k

POOL = 80
#: Queries scored at once against the items of a cell.
TILE = 128
#: Queries of a cell.
QUERY_ROWS = 16_384


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _holders(tags: pd.Series) -> dict[str, np.ndarray]:
    """Positions of the items that have each tag."""
    place = np.repeat(np.arange(len(tags)), tags.map(len))
    flat = [tag for own in tags for tag in own]
    return {tag: place[at] for tag, at in pd.Series(flat, dtype=object).groupby(flat).indices.items()} if flat else {}


def cosine_cell(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Cosine of every query with every item of a cell, best k per query (own id left out).

    Where queries and items carry ``tags``, a query finds only items that share one.
    """
    ids = right["id"].to_numpy()
    order = np.argsort(np.argsort(ids))
    queries, items = _unit(left["vector"]), _unit(right["vector"]).T
    own = left["self_id"].to_numpy() if "self_id" in left else None
    places = right.reset_index(drop=True).groupby("id", dropna=False).indices if own is not None else {}
    holders = _holders(right["tags"]) if "tags" in left else None
    chosen, found = [], []
    for n in range(len(left)):
        if n % TILE == 0:
            # the scores of a whole cell would not fit beside those of other tasks
            scores = np.round(queries[n : n + TILE] @ items, 6)
        line = scores[n % TILE]
        if own is not None:
            line[places.get(own[n], [])] = -np.inf
        if holders is not None:
            allowed = np.zeros(len(ids), bool)
            for tag in left["tags"].iat[n]:
                allowed[holders.get(tag, [])] = True
            line = np.where(allowed, line, -np.inf)
        best = best_rows(line, order, k)
        best = best[np.isfinite(line[best])]
        chosen.append(best)
        found.append(line[best])
    row = np.repeat(np.arange(len(left)), [len(best) for best in chosen])
    return pd.DataFrame({"lane": left["lane"].iloc[0], "qid": left["qid"].to_numpy()[row], "id": ids[np.concatenate(chosen)], "score": np.concatenate(found)})


def nearest(queries: DataFrame, items: DataFrame, k: int = POOL) -> DataFrame:
    """Exact k nearest: ``queries(lane, qid, vector[, self_id])``, ``items(lane, id, vector)``."""
    # an item goes to a cell for each block of queries, so blocks are large: a vector weighs little beside the scores of a tile
    return blocked_top_k(queries, items, cosine_cell, k, query_rows=QUERY_ROWS, item_rows=50_000)


def embedded(queries: DataFrame, embed: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Vectors of the different query texts from a user-supplied batch function text -> vector."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return embed(texts)

    return queries.select("tenant", "query").distinct().withColumn("embedding", run("query"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact result each query got back."""
    hits = exact.select("lane", "qid", "id").join(
        found.select("lane", "qid", "id", F.lit(1).alias("hit")), ["lane", "qid", "id"], "left"
    )
    return hits.groupBy("lane", "qid").agg(
        F.count("id").alias("expected"), F.count("hit").alias("found")
    )
