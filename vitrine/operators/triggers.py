"""Failed-search detection over response logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine import schemas
from vitrine.functions import predicates, text
from vitrine.operators import catalog

SAMPLE_PRODUCTS, GROUNDING_VALUES, TRIGGER_IDS = 8, 30, 6


def parsed(responses: DataFrame) -> DataFrame:
    """Payload JSON to a product list (NULL where there is none) and its metadata."""
    as_array = F.from_json("payload", schemas.RESPONSE_ARRAY)
    as_object = F.from_json("payload", schemas.RESPONSE_OBJECT)
    bare = F.ltrim("payload").startswith("[")
    return (
        responses.withColumn("_object", F.when(~bare, as_object))
        .withColumn(
            "products",
            F.when(bare, as_array).otherwise(F.coalesce("_object.products", "_object.results")),
        )
        .withColumn("is_complex", F.coalesce("_object.metadata.isComplex", F.lit(False)))
        .withColumn("high_text_matches", F.col("_object.metadata.tiers.highTextMatches"))
        .drop("_object", "payload")
    )


def _sellable(product: Column) -> Column:
    return predicates.lenient_stock(product["stockStatus"], product["stock_status"])


def all_words_present(query_words: Column, product_words: Column) -> Column:
    """Every query word is a product word; no query words is no hit."""
    return (F.size(query_words) > 0) & (F.size(F.array_except(query_words, product_words)) == 0)


def _searchable(product: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat_ws(
        " ", product["name"], product["type"],
        F.array_join(F.coalesce(product["category"], none), " "),
        F.array_join(F.coalesce(product["softCategory"], none), " "),
    )


def literal_hit(nfkc: bool = False) -> Column:
    """Tier count if documented, else tier flags or bonuses, else the words themselves."""
    prepare = text.normalize_nfkc if nfkc else (lambda c: c)
    query_words = text.literal_words(prepare(F.col("query")))
    flagged = F.exists(
        "products",
        lambda p: F.coalesce(p["highTextMatch"], F.lit(False))
        | (F.coalesce(F.nullif(p["exactMatchBonus"], F.lit(0.0)), p["textMatchBonus"], F.lit(0.0)) > 0),
    )
    worded = F.exists("products", lambda p: all_words_present(query_words, text.literal_words(_searchable(p))))
    return F.when(F.col("high_text_matches").isNotNull(), F.col("high_text_matches") > 0).otherwise(
        F.coalesce(flagged, F.lit(False)) | F.coalesce(worded, F.lit(False))
    )


def decisions(parsed_rows: DataFrame, auto_open: bool = True, nfkc: bool = False) -> DataFrame:
    """Why a search failed; NULL reason means it did not. Too short queries and unparsable
    payloads yield no row."""
    rows = parsed_rows.filter((F.length(text.js_trim(F.col("query"))) >= 2) & F.col("products").isNotNull())
    rows = rows.withColumn("literal", literal_hit(nfkc))
    sold_out = F.forall("products", lambda p: p.isNotNull() & ~_sellable(p))
    reason = (
        F.when(F.size("products") == 0, "no_results")
        .when(sold_out, "out_of_stock")
        .when(~F.col("literal") | F.col("is_complex"), "non_literal")
    )
    ids = F.filter(
        F.transform(F.slice("products", 1, TRIGGER_IDS), lambda p: F.coalesce(p["id"], p["product_id"], F.lit(""))),
        lambda i: i != "",
    )
    return rows.select(
        *[c for c in parsed_rows.columns if c not in ("products", "is_complex", "high_text_matches")],
        "products", "literal", "is_complex",
        reason.alias("reason"),
        F.lit("auto" if auto_open else "pill").alias("display"),
        ids.alias("product_ids"),
    )


def vetoed(triggers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Remove non-literal rows an external review turned down; no verdict keeps the row."""
    kept = triggers.join(verdicts.select("query_id", "should_trigger"), "query_id", "left")
    turned_down = (F.col("reason") == "non_literal") & ~F.coalesce("should_trigger", F.lit(True))
    return kept.filter(~F.coalesce(turned_down, F.lit(False))).drop("should_trigger")


def grounding(triggers: DataFrame, products: DataFrame) -> DataFrame:
    """Per ambiguous query: its store's top values, size, price range and first fallback products."""
    values = lambda field: (
        catalog.facet(products, field, GROUNDING_VALUES, strict=False)
        .groupBy("tenant")
        .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("v"))
        .select("tenant", F.transform("v", lambda x: x["value"]).alias(f"known_{field}"))
    )
    store = (
        catalog.price_stats(products, strict=False)
        .join(values("category"), "tenant", "left")
        .join(values("soft_category"), "tenant", "left")
    )
    sample = F.transform(F.slice("products", 1, SAMPLE_PRODUCTS), lambda p: p["name"])
    return (
        triggers.filter("reason = 'non_literal'")
        .select("query_id", "tenant", "query", sample.alias("sample_names"))
        .join(store, "tenant")
    )


def longest_category(queries: DataFrame, products: DataFrame) -> DataFrame:
    """The longest catalog category or tag phrase found in each different query text.

    ``queries(tenant, query)``. Word n-grams, as long as the store's longest phrase, meet the
    vocabulary by equality.
    """
    vocabulary = (
        products.select("tenant", F.explode(F.concat("category", "soft_category")).alias("value"))
        .withColumn("phrase", F.array_join(text.index_tokens(F.col("value")), " "))
        .filter("phrase <> ''")
        .groupBy("tenant", "phrase")
        .agg(F.min("value").alias("category"))
    )
    longest = vocabulary.groupBy("tenant").agg(F.max(F.size(F.split("phrase", " "))).alias("most_words"))
    words = text.index_tokens(F.col("query"))
    asked = (
        queries.select("tenant", "query").distinct().withColumn("words", words).filter(F.size("words") > 0)
        .join(longest, "tenant")
    )
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.size("words"), F.col("most_words"))),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")
            ),
        )
    )
    hits = asked.select("tenant", "query", F.explode(F.array_distinct(grams)).alias("phrase")).join(
        vocabulary, ["tenant", "phrase"]
    )
    best = F.min_by("category", F.struct(-F.length("phrase"), F.col("phrase")))
    return hits.groupBy("tenant", "query").agg(best.alias("category"))


def recovered(turns: DataFrame, triggers: DataFrame, minutes: int = 30) -> DataFrame:
    """Chat turns with the newest trigger of their conversation parked at most 30 minutes before."""
    from vitrine.operators.running import as_of

    matched = as_of(
        turns, triggers.withColumnRenamed("ts", "parked_at"), ["conversation_id"], "ts", "parked_at", "parked_at",
        ["trigger_reason", "trigger_query"],
    )
    alive = F.col("matched_parked_at") >= F.col("ts") - F.expr(f"INTERVAL {minutes} MINUTES")
    return matched.select(
        *turns.columns,
        F.when(alive, F.col("trigger_reason")).alias("trigger_reason"),
        F.when(alive, F.col("trigger_query")).alias("trigger_query"),
    )


def known_reason(reason: Column) -> Column:
    """Only the known trigger reasons survive."""
    return F.when(reason.isin(*text.TRIGGER_REASONS), reason)


def understood(queries: DataFrame, products: DataFrame) -> DataFrame:
    """Script, complexity, price filters, category and cleaned text of each different query.

    The words of the extracted category are filter words and leave the cleaned query.
    """
    q = F.col("query")
    asked = queries.select("tenant", "query").distinct()
    found = asked.join(longest_category(asked, products), ["tenant", "query"], "left")
    stop = text.index_tokens(F.coalesce("category", F.lit("")))
    return found.select(
        "tenant", "query", text.has_hebrew(q).alias("hebrew"), text.is_simple_query(q).alias("simple"),
        text.price_filters(q).alias("filters"), "category", text.clean_query(q, stop).alias("cleaned"),
    )
