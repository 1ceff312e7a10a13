"""Whole search plans: hybrid retrieval, tiers, second tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vitrine.functions import text

from vitrine.operators import fusion, lexical, tiers
from vitrine.session import checkpointed


def retrieve(searches: DataFrame, products: DataFrame, vectors: DataFrame, index=None, lists=None):
    """Lexical and vector hits for the different (tenant, stock switch, query) of ``searches``.

    ``index`` is a text or an impact index, ``lists`` may be inverted lists of the products; rows are the same.
    """
    index = index or lexical.stored_index(products)
    keyed = searches.withColumn("lane", fusion.lane(F.col("tenant"), F.col("in_stock")))
    asked = keyed.select("lane", "tenant", "query").distinct()
    return fusion.text_hits(asked, products, index), fusion.vector_hits(asked, products, vectors, lists=lists)


def hybrid_search(requests: DataFrame, products: DataFrame, vectors: DataFrame, index=None) -> DataFrame:
    """Fused, filtered and ordered results of every different search in a request log.

    One row per search and result; ``requests`` says how many log rows the search stands for. Join
    ``fusion.distinct_searches`` on its key columns to get back to single requests.
    """
    # The different searches feed every branch below: reduced from the log once.
    searches = checkpointed(fusion.distinct_searches(requests))
    lexical_hits, vector_hits = retrieve(searches, products, vectors, index)
    attributes = products.select(
        "tenant", "id", "price", "category", "soft_category", "stock_status_canonical", "stock_status_legacy"
    )
    lexical_matches = F.count("text_rank").over(Window.partitionBy("lane", "qid"))
    pool = (
        fusion.fuse(lexical_hits, vector_hits)
        .select("*", lexical_matches.alias("lexical_matches"), F.split_part("lane", F.lit("|"), F.lit(1)).alias("tenant"))
        .join(attributes, ["tenant", "id"])
        .drop("tenant")
    )
    asked = searches.withColumn("lane", fusion.lane(F.col("tenant"), F.col("in_stock"))).withColumn("qid", F.col("query"))
    rows = fusion.post_filter(asked.join(pool, ["lane", "qid"]))
    return fusion.limited(rows, fusion.result_order(fusion.fused_order()))


def browse_search(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Results of every different search without text: the filters alone choose, in price or id order.

    The first rows are cut by price bounds and stock; categories and tags are tested after the cut, as in a text search.
    """
    searches = checkpointed(fusion.distinct_searches(requests))
    found = fusion.browse(searches, products).select(F.col("qid").cast("long").alias("search_id"), "id", "rank")
    attributes = products.select(
        "tenant", "id", "price", "category", "soft_category", "stock_status_canonical", "stock_status_legacy"
    )
    rows = fusion.post_filter(searches.join(found, "search_id").join(attributes, ["tenant", "id"]))
    return fusion.limited(rows, fusion.result_order([F.col("rank")]))


def routed_search(requests: DataFrame, products: DataFrame, vectors: DataFrame, index=None) -> DataFrame:
    """A whole request log: searches with text are retrieved, those without browse by their filters."""
    blank = text.js_trim(F.coalesce("query", F.lit(""))) == ""
    shared = ["search_id", "requests", "tenant", "query", "in_stock", "position", "id", "total_matched", "returned"]
    typed = hybrid_search(requests.filter(~blank), products, vectors, index)
    browsed = browse_search(requests.filter(blank).withColumn("query", F.lit("")), products)
    return typed.select(*shared, "rrf", "lexical_matches", F.lit(False).alias("browsed")).unionByName(
        browsed.select(*shared, F.lit(None).cast("double").alias("rrf"), F.lit(None).cast("long").alias("lexical_matches"), F.lit(True).alias("browsed"))
    )


def ranked_pool(requests: DataFrame, products: DataFrame, vectors: DataFrame, index=None) -> DataFrame:
    """Fused pool of every different (stock switch, query), scored and ranked by tiers."""
    searches = checkpointed(
        requests.select(
            "tenant", text.js_trim("query").alias("query"), F.coalesce("in_stock", F.lit(True)).alias("in_stock")
        ).distinct()
    )
    lexical_hits, vector_hits = retrieve(searches, products, vectors, index)
    pool = fusion.fuse(lexical_hits, vector_hits).withColumn("tenant", F.split_part("lane", F.lit("|"), F.lit(1)))
    return tiers.tiered(tiers.scored_pool(pool, products))


def tiered_search(requests: DataFrame, products: DataFrame, vectors: DataFrame, index=None) -> DataFrame:
    """First page of every different query with tier flags."""
    return ranked_pool(requests, products, vectors, index).filter(F.col("rank") < tiers.FIRST_TIER_ROWS)


def expand_second_tier(requests: DataFrame, products: DataFrame, vectors: DataFrame, index=None) -> DataFrame:
    """Second-tier pages of every different query that has near-exact name matches."""
    index = index or lexical.stored_index(products)
    # Read several times below and at most twice the pool size per query: written once.
    ranked = checkpointed(ranked_pool(requests, products, vectors, index))
    return fusion.paged(tiers.second_tier(ranked, products, vectors, index), "rank")
