"""Catalog scans, shaping, lookups, facets, alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import predicates, text
from vitrine.operators import lexical, neighbour_graph, vector
from vitrine.operators.running import numbered

CATEGORY_FACETS, TAG_FACETS = 60, 80
MAX_ALTERNATIVES = 12
MAX_SELECTION, HIGHLIGHT_CHARS = 25, 120
LIST_DESCRIPTION, DETAIL_DESCRIPTION = 500, 1600


def normalise(raw: DataFrame) -> DataFrame:
    """Raw feed rows to catalog rows: id from the first field present, lists, numeric price."""
    return raw.select(
        F.coalesce("id", "item_id", "row_id").alias("id"),
        "tenant",
        "name",
        text.as_list(F.col("category")).alias("category"),
        text.as_list(F.col("soft_category")).alias("soft_category"),
        F.col("price").try_cast("double").alias("price"),
    )


def in_stock() -> Column:
    return predicates.lenient_stock(F.col("stock_status_canonical"), F.col("stock_status_legacy"))


def shaped(products: DataFrame, description_chars: int = LIST_DESCRIPTION) -> DataFrame:
    """The twelve-field product row shown to clients."""
    return products.select(
        "tenant",
        F.col("id").alias("product_id"),
        F.nullif("name", F.lit("")).alias("name"),
        "price",
        in_stock().alias("in_stock"),
        F.col("category").alias("categories"),
        F.col("soft_category").alias("tags"),
        "colors",
        "type",
        (F.coalesce(F.size("special_sales"), F.lit(0)) > 0).alias("on_sale"),
        text.strip_and_clip(F.col("description"), description_chars).alias("description"),
        "url",
        "image",
    )


def cards(shaped_rows: DataFrame) -> DataFrame:
    extra = ["match_reason"] if "match_reason" in shaped_rows.columns else []
    return shaped_rows.select("product_id", "name", "price", "in_stock", "url", "image", *extra)


def facet(products: DataFrame, field: str, limit: int, strict: bool = True) -> DataFrame:
    """Most frequent values of a list field per tenant; empty values go after the cut."""
    rows = products.filter(predicates.visible(F.col("hidden")))
    if strict:
        rows = rows.filter(predicates.strict_stock(F.col("stock_status_canonical")))
    counts = rows.select("tenant", F.explode(field).alias("value")).groupBy("tenant", "value").agg(F.count("*").alias("products"))
    w = Window.partitionBy("tenant").orderBy(F.desc("products"), "value")
    return (
        counts.withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= limit)
        .filter("value is not null and value <> ''")
    )


def price_stats(products: DataFrame, strict: bool = True) -> DataFrame:
    """Price range per tenant. ``priced_products`` counts numeric prices only, ``products`` all."""
    rows = products.filter(predicates.visible(F.col("hidden")))
    if strict:
        rows = rows.filter(predicates.strict_stock(F.col("stock_status_canonical")))
    return rows.groupBy("tenant").agg(
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count("price").alias("priced_products"),
        F.count("*").alias("products"),
    )


def facets(products: DataFrame) -> DataFrame:
    """Category and tag facets with the tenant's price statistics on every row."""
    values = facet(products, "category", CATEGORY_FACETS).select(F.lit("category").alias("kind"), "*").unionByName(
        facet(products, "soft_category", TAG_FACETS).select(F.lit("tag").alias("kind"), "*")
    )
    return values.withColumnRenamed("products", "value_count").join(price_stats(products), "tenant")


def coverage(products: DataFrame) -> DataFrame:
    """Share of products with a vector, a price and a stock field, per tenant."""
    share = lambda c: F.round(F.count(c) / F.count("*"), 6)
    return products.groupBy("tenant").agg(
        F.count("*").alias("products"),
        share("embedding").alias("with_vector"),
        share("price").alias("with_price"),
        share("stock_status_canonical").alias("with_stock"),
    )


def ids_by_name_part(lookups: DataFrame, products: DataFrame) -> DataFrame:
    """First visible product (by id) whose name contains each looked-up text, case-insensitive.

    Substrings of names are cut only where a looked-up text of that length could start (same first
    three characters), reduced to the lowest id each, and joined by equality: work grows with the
    names and texts, never with pairs of them.
    """
    head = lambda c: F.substring(c, 1, 3)
    wanted = lookups.select("tenant", F.lower(text.js_trim("name")).alias("part")).filter("part <> ''").distinct()
    shapes = wanted.select("tenant", head("part").alias("head"), F.length("part").alias("size")).distinct()
    starts = (
        products.filter(predicates.visible(F.col("hidden")))
        .groupBy("tenant", F.lower("name").alias("low"))
        .agg(F.min("id").alias("id"))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("low"))))
        .withColumn("rest", F.expr("substring(low, at)"))
    )
    heads = F.explode(F.array_distinct(F.array(*[F.substring("rest", 1, n) for n in (1, 2, 3)])))
    cut = (
        starts.select("tenant", "id", "rest", heads.alias("head"))
        .join(shapes, ["tenant", "head"])
        .filter(F.length("rest") >= F.col("size"))
        .groupBy("tenant", F.expr("substring(rest, 1, size)").alias("part"))
        .agg(F.min("id").alias("id"))
    )
    return wanted.join(cut, ["tenant", "part"])


def look_up(lookups: DataFrame, products: DataFrame) -> DataFrame:
    """One visible product per lookup by id or by name part, the lowest id when several match.

    ``lookups(tenant, product_id, name)``, either field may be NULL.
    """
    shown = products.filter(predicates.visible(F.col("hidden"))).select("tenant", "id")
    distinct = lookups.select("tenant", "product_id", "name").distinct().withColumn("part", F.lower(text.js_trim("name")))
    by_id = distinct.filter("product_id is not null").join(
        shown.withColumnRenamed("id", "product_id").distinct(), ["tenant", "product_id"], "left_semi"
    ).select("tenant", "product_id", "name", F.col("product_id").alias("found"))
    by_name = distinct.join(ids_by_name_part(lookups.filter("name is not null"), products), ["tenant", "part"]).select(
        "tenant", "product_id", "name", F.col("id").alias("found")
    )
    hits = by_id.unionByName(by_name).groupBy("tenant", "product_id", "name").agg(F.min("found").alias("found_id"))
    keys = ["tenant", "product_id", "name"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"h.{c}")) for c in keys]
    return distinct.alias("a").join(hits.alias("h"), same, "left").select(*[f"a.{c}" for c in keys], "found_id")


def selection(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Requested ids in requested order, only visible and in stock, with a clipped highlight.

    ``requests(request_id, tenant, product_ids, highlights)``; repeats stay.
    """
    wanted = requests.select(
        "request_id",
        F.posexplode(F.slice("product_ids", 1, MAX_SELECTION)).alias("position", "product_id"),
        "highlights",
    ).select(
        "request_id", "position", "product_id",
        text.strip_and_clip(F.try_element_at("highlights", F.col("product_id")), HIGHLIGHT_CHARS).alias("match_reason"),
    )
    sellable = shaped(products.filter(predicates.visible(F.col("hidden")))).filter("in_stock").drop("tenant")
    return wanted.join(sellable, "product_id")


def alternatives(
    sources: DataFrame, products: DataFrame, index: lexical.TextIndex, limit: int = 5, graph: DataFrame | None = None
) -> DataFrame:
    """Nearest purchasable products per source; sources without a vector fall back to text search.

    The fallback searches the source's name and, like the search itself, may return the source. With a neighbour
    graph of the stores' products the nearest ones are read from it instead of being searched exactly.
    """
    limit = min(max(limit or 5, 1), MAX_ALTERNATIVES)
    visible = products.filter(predicates.visible(F.col("hidden")))
    items = visible.filter(predicates.strict_stock(F.col("stock_status_canonical")) & F.col("embedding").isNotNull()).select(
        F.col("tenant").alias("lane"), "id", F.col("embedding").alias("vector")
    )
    with_vector = sources.filter("embedding is not null").select(
        F.col("tenant").alias("lane"), F.col("id").alias("qid"), F.col("id").alias("self_id"), F.col("embedding").alias("vector")
    )
    nearest = vector.nearest(with_vector, items, limit) if graph is None else neighbour_graph.nearest(with_vector, items, graph, limit)
    near = nearest.select(
        F.col("lane").alias("tenant"), F.col("qid").alias("source_id"), F.lit("similar_products").alias("method"),
        (F.col("rank") + 1).cast("long").alias("position"), "id",
    )
    without = sources.filter("embedding is null").select("tenant", F.col("id").alias("source_id"), "name")
    queries = without.select("tenant", "name").distinct().select(
        F.col("tenant").alias("lane"), F.col("name").alias("qid"), "tenant", F.col("name").alias("query")
    )
    lanes = visible.filter(in_stock()).select(F.col("tenant").alias("lane"), "tenant", "id")
    worded = lexical.retrieve(queries, lanes, index, limit).select(
        F.col("lane").alias("tenant"), F.col("qid").alias("name"), (F.col("rank") + 1).cast("long").alias("position"), "id"
    )
    far = without.join(worded, ["tenant", "name"]).select(
        "tenant", "source_id", F.lit("text_similarity").alias("method"), "position", "id"
    )
    return near.unionByName(far)


def price_places(products: DataFrame) -> DataFrame:
    """1-based place of every product in its store's ascending and descending price order.

    Products without a price come last in both; ties by id. A store is numbered range by range, not in one task.
    """
    rows = numbered(products.select("tenant", "id", "price"), ["tenant"], [F.asc_nulls_last("price"), "id"], "cheapest")
    return numbered(rows, ["tenant"], [F.desc_nulls_last("price"), "id"], "dearest").select("tenant", "id", "cheapest", "dearest")
