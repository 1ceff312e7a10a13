"""Result tiers: name-match bonus, seeds, similar products, second-tier order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import matching, predicates, text
from vitrine.operators import blocks, fusion, lexical, neighbour_graph, vector
from vitrine.session import checkpointed, written

FIRST_TIER_ROWS = 25
SEEDS, PER_SEED = 3, 20
TOP_FOR_SOFT = 4
#: Between a lane and the shelf of it that is searched.
SHELF = "\u0001"


def scored_pool(pool: DataFrame, products: DataFrame) -> DataFrame:
    """Fused pool with product attributes, name bonus, tier flag and soft-category overlap.

    ``pool(lane, qid, tenant, id, rrf, ranks)``; the query's own words are its wished soft
    categories.
    """
    attributes = products.select("tenant", "id", "name", "category", "soft_category")
    query = F.col("qid")
    rows = pool.join(attributes, ["tenant", "id"])
    simple = text.is_simple_query(query)
    words = F.transform(text.index_tokens(query), F.lower)
    bonus = matching.name_match_bonus(F.col("name"), query, text.clean_query(query, F.array(F.lit("brand"))))
    return (
        rows.withColumn("bonus", bonus)
        .withColumn("simple", simple)
        .withColumn("high_text_match", F.when(simple, F.col("bonus") >= matching.HIGH_TEXT_MATCH))
        .withColumn("soft_hits", matching.soft_matches(F.transform("soft_category", F.lower), words))
    )


def tier_order():
    """Bonus, then two or more soft matches, then one, then the fused score."""
    step = F.when(F.col("soft_hits") >= 2, 2).when(F.col("soft_hits") == 1, 1).otherwise(0)
    return [F.desc("bonus"), F.desc(step), *fusion.fused_order()]


def tiered(scored: DataFrame) -> DataFrame:
    """0-based rank: simple queries by tier order, complex ones by the fused order."""
    simple_first = [F.when(F.col("simple"), F.col("bonus")), F.when(F.col("simple"), F.least("soft_hits", F.lit(2)))]
    w = Window.partitionBy("lane", "qid").orderBy(*[F.desc_nulls_last(c) for c in simple_first], *fusion.fused_order())
    return scored.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def tier_counts(first_page: DataFrame) -> DataFrame:
    """Tier statistics per simple query."""
    counts = first_page.filter("simple").groupBy("lane", "qid").agg(
        F.count_if("high_text_match").alias("high_text_matches"),
        F.count_if(~F.col("high_text_match")).alias("other_results"),
    )
    return counts.withColumn(
        "description",
        F.format_string("%d high text matches, %d related results", "high_text_matches", "other_results"),
    )


def seeds(ranked: DataFrame) -> DataFrame:
    """At most three near-exact name matches per query."""
    w = Window.partitionBy("lane", "qid").orderBy(F.desc("bonus"), "rank")
    return (
        ranked.filter(F.col("bonus") >= matching.SEED_BONUS)
        .withColumn("seed", F.row_number().over(w))
        .filter(F.col("seed") <= SEEDS)
    )


def shelf_items(products: DataFrame) -> DataFrame:
    """(tenant, id, lane, vector, stock_status_canonical): a product in the lane of each of its categories."""
    return products.filter("embedding is not null").select(
        "tenant", "id", F.explode("category").alias("shelf"), "stock_status_canonical", F.col("embedding").alias("vector")
    ).withColumn("lane", F.concat_ws("|", "tenant", "shelf"))


def similar_to_seeds(seed_rows: DataFrame, products: DataFrame, k: int = PER_SEED, graph: DataFrame | None = None) -> DataFrame:
    """Nearest in-stock products per different seed product inside its own categories.

    With a neighbour graph of `shelf_items` they are read from it instead of being searched exactly.
    """
    vectors = shelf_items(products)
    # a few products of a whole retrieval, read by every branch of the search below
    wanted = written(seed_rows.select("tenant", "id").distinct(), "seeds")
    queries = vectors.join(wanted, ["tenant", "id"], "left_semi").select(
        "lane", F.col("id").alias("qid"), F.col("id").alias("self_id"), "vector"
    )
    items = vectors.filter(predicates.strict_stock(F.col("stock_status_canonical"))).select("lane", "id", "vector")
    found = vector.nearest(queries, items, k) if graph is None else neighbour_graph.nearest(queries, items, graph, k)
    per_seed = found.groupBy(F.split_part("lane", F.lit("|"), F.lit(1)).alias("tenant"), F.col("qid").alias("seed_id"), "id").agg(
        F.max("score").alias("score")
    )
    w = Window.partitionBy("tenant", "seed_id").orderBy(F.desc("score"), "id")
    return per_seed.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


def top_soft_categories(ranked: DataFrame, rows: int = TOP_FOR_SOFT) -> DataFrame:
    """Soft categories of the best results of each query."""
    return (
        ranked.filter(F.col("rank") < rows)
        .select("lane", "qid", F.explode("soft_category").alias("soft"))
        .groupBy("lane", "qid")
        .agg(F.sort_array(F.collect_set("soft")).alias("wanted_soft"))
    )


def merge_sources(soft: DataFrame, similar: DataFrame) -> DataFrame:
    """Union of both second-tier sources with the boost of how a product was found."""
    tagged = soft.select("lane", "qid", "tenant", "id", F.lit("soft_category").alias("source")).unionByName(
        similar.select("lane", "qid", "tenant", "id", F.lit("product_similarity").alias("source"))
    )
    merged = tagged.groupBy("lane", "qid", "tenant", "id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    boost = (
        F.when(F.size("sources") == 2, 5000).when(F.array_contains("sources", "product_similarity"), 2500).otherwise(0)
    )
    return merged.withColumn("similarity_boost", boost.cast("long"))


def _on_shelf(lane: Column, shelf: Column) -> Column:
    return F.concat(lane, F.lit(SHELF), shelf)


def _off_shelf(hits: DataFrame, k: int) -> DataFrame:
    """Hits of shelves as hits of their searches, the best k of each."""
    lane = F.split_part("lane", F.lit(SHELF), F.lit(1)).alias("lane")
    return blocks.ranked(hits.groupBy(lane, "qid", "id").agg(F.max("score").alias("score")), k)


def soft_category_search(contexts: DataFrame, products: DataFrame, vectors: DataFrame, index: lexical.TextIndex, k: int = fusion.POOL) -> DataFrame:
    """Text and vector search of its own over the products of wanted categories, fused.

    ``contexts(lane, tenant, qid, shelves, wanted_soft)``: a product is eligible that stands on one of the
    shelves (hard categories) and has one of the soft categories. A shelf is a lane of the block plan and
    soft categories are tags in its cells, so nothing outside the shelves is scored, and the filter
    comes before the best k, however many products the first search has left out.
    """
    asked = contexts.select("lane", "tenant", "qid", F.explode("shelves").alias("shelf"), F.col("wanted_soft").alias("tags"))
    asked = asked.select(_on_shelf(F.col("lane"), F.col("shelf")).alias("lane"), "tenant", "qid", "tags")

    def shelved(strict: bool, rows: DataFrame) -> DataFrame:
        return (
            fusion.stock_lanes(rows, strict).withColumn("shelf", F.explode(F.array_distinct("category")))
            .withColumn("lane", _on_shelf(F.col("lane"), F.col("shelf")))
            .withColumn("tags", F.array_distinct(F.coalesce("soft_category", F.array().cast("array<string>"))))
        )

    held = shelved(False, products.drop("embedding")).select("lane", "tenant", "id", "tags")
    tag_rows = lambda df, key: df.select("lane", key, F.explode("tags").alias("tag"))
    by_text = lexical.retrieve(
        asked.select("lane", "qid", "tenant", F.col("qid").alias("query")), held.select("lane", "tenant", "id"), index, k,
        (tag_rows(asked, "qid"), tag_rows(held, "id")),
    )
    queries = asked.join(vectors.select("tenant", F.col("query").alias("qid"), F.col("embedding").alias("vector")), ["tenant", "qid"])
    items = shelved(True, products.filter("embedding is not null")).select("lane", "id", F.col("embedding").alias("vector"), "tags")
    by_vector = vector.nearest(queries.select("lane", "qid", "vector", "tags"), items, k)
    return fusion.fuse(_off_shelf(by_text, k), _off_shelf(by_vector, k))


def second_tier(
    ranked: DataFrame, products: DataFrame, vectors: DataFrame, index: lexical.TextIndex, first_rows: int = FIRST_TIER_ROWS
) -> DataFrame:
    """Second tier of every query that has seeds, without what the first tier delivered.

    Soft results come from a search of their own (``soft_category_search``) with the soft categories of
    the query's best results and the hard categories of its seeds; similar results are the seeds' neighbours.
    """
    chosen = seeds(ranked)
    shelves = chosen.groupBy("lane", "qid", "tenant").agg(F.array_distinct(F.flatten(F.collect_list("category"))).alias("shelves"))
    # searched by two retrievers; a few values per query
    contexts = checkpointed(shelves.join(top_soft_categories(ranked), ["lane", "qid"]))
    found = checkpointed(soft_category_search(contexts, products, vectors, index))
    soft = found.withColumn("tenant", F.split_part("lane", F.lit("|"), F.lit(1)))
    similar = chosen.select("lane", "qid", "tenant", F.col("id").alias("seed_id")).join(
        similar_to_seeds(chosen, products), ["tenant", "seed_id"]
    ).select("lane", "qid", "tenant", "id").distinct()
    merged = merge_sources(soft, similar)
    delivered = ranked.filter(F.col("rank") < first_rows)
    rest = fusion.without_delivered(merged, delivered, ["lane", "qid", "id"])
    rows = scored_pool(rest.join(found, ["lane", "qid", "id"], "left"), products)
    w = Window.partitionBy("lane", "qid").orderBy(
        F.desc("similarity_boost"), F.desc(F.coalesce("rrf", F.lit(0.0))), F.desc("bonus"), F.desc("soft_hits"), "id"
    )
    return rows.select(
        "lane", "qid", "tenant", "id", "sources", "similarity_boost", "rrf", "bonus", "soft_hits", (F.row_number().over(w) - 1).cast("long").alias("rank")
    )


def category_mix(rows: DataFrame, products: DataFrame, first: int = 10) -> DataFrame:
    """Category distribution of the first rows of each query's second tier."""
    return (
        rows.filter(F.col("rank") < first)
        .join(products.select("tenant", "id", "category"), ["tenant", "id"])
        .select("lane", "qid", F.explode("category").alias("category"))
        .groupBy("lane", "qid", "category")
        .agg(F.count("*").alias("products"))
    )
