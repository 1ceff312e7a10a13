"""Rank fusion, post-filters, result order and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import matching, predicates, text
from vitrine.operators import impact, inverted_lists, lexical, vector
from vitrine.operators.blocks import blocked_top_k

POOL = 80
DEFAULT_LIMIT, MAX_LIMIT = 12, 25
PAGE_ROWS, MAX_DELIVERED = 20, 65
FILTERS = ["price_min", "price_max", "categories", "tags", "in_stock", "sort", "limit"]


def distinct_searches(requests: DataFrame) -> DataFrame:
    """One row per different search with the number of requests behind it.

    A query asked a million times is retrieved once. ``search_id`` is the first request's id.
    """
    keyed = requests.withColumn("in_stock", F.coalesce("in_stock", F.lit(True))).withColumn(
        "query", text.js_trim("query")
    )
    return keyed.groupBy("tenant", "query", *FILTERS).agg(
        F.min("query_id").alias("search_id"), F.count("*").alias("requests")
    )


def lane(tenant: Column, in_stock: Column) -> Column:
    return F.concat_ws("|", tenant, F.when(in_stock, "instock").otherwise("all"))


def stock_lanes(products: DataFrame, strict: bool) -> DataFrame:
    """Every visible product in the lanes it is eligible for: all, and in stock."""
    sellable = (
        predicates.strict_stock(F.col("stock_status_canonical"))
        if strict
        else predicates.lenient_stock(F.col("stock_status_canonical"), F.col("stock_status_legacy"))
    )
    wanted = F.array_compact(F.array(F.lit(False), F.when(sellable, True)))
    return (
        products.filter(predicates.visible(F.col("hidden")))
        .withColumn("_in_stock", F.explode(wanted))
        .withColumn("lane", lane(F.col("tenant"), F.col("_in_stock")))
        .drop("_in_stock")
    )


def text_hits(searches: DataFrame, products: DataFrame, index: lexical.TextIndex | impact.ImpactIndex, k: int = POOL) -> DataFrame:
    """The same rows with either index; an impact index leaves out blocks that cannot hold one."""
    queries = searches.select("lane", F.col("query").alias("qid"), "tenant", "query").distinct()
    lanes = stock_lanes(products.drop("embedding"), strict=False).select("lane", "tenant", "id")
    if isinstance(index, impact.ImpactIndex):
        return impact.retrieve(queries, lanes, index, k)[0]
    return lexical.retrieve(queries, lanes, index, k)


def vector_hits(searches: DataFrame, products: DataFrame, vectors: DataFrame, k: int = POOL, lists: inverted_lists.VectorLists | None = None) -> DataFrame:
    """``vectors(tenant, query, embedding)``; searches without a vector get no rows.

    The same rows with ``lists`` of the products, which leave out those that cannot hold one.
    """
    queries = (
        searches.select("lane", "tenant", "query")
        .distinct()
        .join(vectors, ["tenant", "query"])
        .select("lane", F.col("query").alias("qid"), F.col("embedding").alias("vector"))
    )
    if lists is not None:
        return inverted_lists.nearest_pruned(queries, lists, k)[0]
    items = stock_lanes(products.filter("embedding is not null"), strict=True).select(
        "lane", "id", F.col("embedding").alias("vector")
    )
    return vector.nearest(queries, items, k)


def fuse(text: DataFrame, vec: DataFrame) -> DataFrame:
    """Weighted reciprocal-rank fusion; text outweighs vector, ties keep text order first."""
    no_rank = F.lit(None).cast("int")
    both = text.select(
        "lane", "qid", "id", F.col("rank").alias("text_rank"), no_rank.alias("vector_rank"),
        matching.rrf(F.col("rank"), matching.TEXT_WEIGHT).alias("share"),
    ).unionByName(
        vec.select(
            "lane", "qid", "id", no_rank.alias("text_rank"), F.col("rank").alias("vector_rank"),
            matching.rrf(F.col("rank"), matching.VECTOR_WEIGHT).alias("share"),
        )
    )
    return both.groupBy("lane", "qid", "id").agg(
        F.sum("share").alias("rrf"), F.min("text_rank").alias("text_rank"), F.min("vector_rank").alias("vector_rank")
    )


def fused_order() -> list[Column]:
    return [F.desc("rrf"), F.asc_nulls_last("text_rank"), F.asc_nulls_last("vector_rank")]


def post_filter(rows: DataFrame) -> DataFrame:
    """Price range, taxonomy wishes and, for in-stock searches, the lenient stock test."""
    stock = predicates.lenient_stock(F.col("stock_status_canonical"), F.col("stock_status_legacy"))
    return rows.filter(
        predicates.price_between(F.col("price"), F.col("price_min"), F.col("price_max"))
        & predicates.taxonomy_match(F.col("category"), F.col("categories"))
        & predicates.taxonomy_match(F.col("soft_category"), F.col("tags"))
        & (~F.col("in_stock") | stock)
    )


def result_order(base: list[Column]) -> list[Column]:
    """Price order where asked for, products without price last both ways, then the base order."""
    price = F.when(F.col("sort") == "price_asc", F.col("price")).when(F.col("sort") == "price_desc", -F.col("price"))
    return [F.asc_nulls_last(price), *base]


def limited(rows: DataFrame, order: list[Column]) -> DataFrame:
    """First rows per search up to its clamped limit, with the total before the cut."""
    per_search = Window.partitionBy("search_id")
    limit = predicates.clamp_limit(F.col("limit"), DEFAULT_LIMIT, 1, MAX_LIMIT)
    return (
        rows.withColumn("position", F.row_number().over(per_search.orderBy(*order)))
        .withColumn("total_matched", F.count("*").over(per_search))
        .withColumn("returned", F.least("total_matched", limit.cast("long")))
        .filter(F.col("position") <= limit)
    )


def browse_cell(left, right, k):
    """Filter-only searches in one cell: price bounds, then price or id order."""
    import numpy as np
    import pandas as pd

    from vitrine.operators.blocks import best_rows

    ids = right["id"].to_numpy().astype(str)
    order = np.argsort(np.argsort(ids))
    price = right["price"].to_numpy(dtype=float)
    missing = np.isnan(price)
    out = []
    for row in left.itertuples(index=False):
        keep = np.ones(len(price), dtype=bool)
        if row.price_min is not None and not np.isnan(row.price_min):
            keep &= price >= row.price_min
        if row.price_max is not None and not np.isnan(row.price_max):
            keep &= price <= row.price_max
        if row.sort == "price_asc":
            score = np.where(missing, np.inf, -price)
        elif row.sort == "price_desc":
            score = np.where(missing, -np.inf, price)
        else:
            score = np.zeros(len(price))
        found = np.flatnonzero(keep)
        best = found[best_rows(score[found], order[found], k)]
        out.append(pd.DataFrame({"qid": row.qid, "id": ids[best], "score": score[best]}))
    result = pd.concat(out)
    result.insert(0, "lane", left["lane"].iloc[0])
    return result


def browse(searches: DataFrame, products: DataFrame, k: int = POOL) -> DataFrame:
    """First k products of filter-only searches (the store sorts missing prices lowest)."""
    queries = searches.select(
        lane(F.col("tenant"), F.col("in_stock")).alias("lane"),
        F.col("search_id").cast("string").alias("qid"), "price_min", "price_max", "sort",
    )
    items = stock_lanes(products, strict=False).select("lane", "id", "price")
    return blocked_top_k(queries, items, browse_cell, k)


def without_delivered(results: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    """Drop products an earlier batch already carried; repeats among the rest stay."""
    return results.join(delivered.select(*keys).distinct(), keys, "left_anti")


def paged(results: DataFrame, rank: str = "rank", rows: int = PAGE_ROWS, most: int = MAX_DELIVERED) -> DataFrame:
    """Batch number of each 0-based rank, up to the most rows ever delivered."""
    return results.filter(F.col(rank) < most).withColumn("batch", F.floor(F.col(rank) / rows) + 1)


def reranked(results: DataFrame, external: DataFrame, keys: list[str]) -> DataFrame:
    """An external order (keys, id, new_rank) overrides the fused one where it is given."""
    return results.join(external, [*keys, "id"], "left").withColumn(
        "final_rank", F.coalesce("new_rank", "rank").cast("long")
    )


def pinned_first(results: DataFrame, pins: DataFrame) -> DataFrame:
    """Pinned products ahead of the ranked ones for the verbatim query, no product twice.

    ``results(tenant, in_stock, query, id, rank)``, ``pins(tenant, query, id, pin_position)``; pins hold
    for searches with and without the stock switch.
    """
    search = ["tenant", "in_stock", "query"]
    asked = results.select(*search).distinct()
    merged = (
        results.select(*search, "id", "rank", F.lit(None).cast("int").alias("pin_position"))
        .unionByName(
            pins.join(asked, ["tenant", "query"]).select(*search, "id", F.lit(None).cast("int").alias("rank"), "pin_position")
        )
        .groupBy(*search, "id")
        .agg(F.min("rank").alias("rank"), F.min("pin_position").alias("pin_position"))
    )
    w = Window.partitionBy(*search).orderBy(F.asc_nulls_last("pin_position"), F.asc_nulls_last("rank"), "id")
    return merged.withColumn("position", F.row_number().over(w))


def clean_filters(log: DataFrame, lists: list[str], texts: list[str]) -> DataFrame:
    """Blank texts and blank list members removed; what is left empty becomes NULL."""
    blank = lambda c: c.isNull() | (text.js_trim(c) == "")
    tidy = {c: F.when(~blank(F.col(c)), F.col(c)) for c in texts}
    for c in lists:
        members = F.filter(c, lambda v: ~blank(v))
        tidy[c] = F.when(F.size(members) > 0, members)
    return log.withColumns(tidy)


def with_page_state(pages: DataFrame, keys: list[str], rows: int = PAGE_ROWS) -> DataFrame:
    """How much each batch has delivered so far and whether more follows."""
    available = F.count("*").over(Window.partitionBy(*keys))
    upto = F.col("batch") * rows
    return pages.withColumn("has_more", available > upto).withColumn("total_delivered", F.least(available, upto))


def renumbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """0-based position of the rows left per key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("position", (F.row_number().over(w) - 1).cast("long"))
