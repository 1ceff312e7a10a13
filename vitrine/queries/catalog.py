"""Catalog scans, predicates, lookups and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import predicates, text
from vitrine.operators import catalog, chat, fusion, sketches, triggers
from vitrine.queries.registry import query
from vitrine.sources import bind


@query(
    "catalog_scan",
    "SELECT id, tenant, name, price, boost FROM products_v",
)
def catalog_scan(spark, sf):
    return bind.products(spark, sf).select("id", "tenant", "name", "price", "boost")


@query(
    "catalog_normalise",
    """SELECT CASE WHEN p_partkey % 4 = 0 THEN 'item' || p_partkey WHEN p_partkey % 4 = 1 THEN 'row' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id,
  's' || (p_partkey % 3) AS tenant, CASE WHEN p_partkey % 2 = 0 THEN p_type || '|' || p_brand ELSE p_type END AS category,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS tags, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price FROM part""",
)
def catalog_normalise(spark, sf):
    key = F.col("p_partkey")
    raw = bind.table(spark, sf, "part").select(
        F.when(key % 4 >= 2, key.cast("string")).alias("id"),
        F.when(key % 4 == 0, F.concat(F.lit("item"), key.cast("string"))).alias("item_id"),
        F.concat(F.lit("row"), key.cast("string")).alias("row_id"),
        F.concat(F.lit("s"), F.pmod(key, F.lit(3)).cast("string")).alias("tenant"),
        F.col("p_name").alias("name"),
        F.when(key % 2 == 0, F.concat(F.lit(" "), F.col("p_type"), F.lit(" ,, "), F.col("p_brand"), F.lit(" ,")))
        .otherwise(F.col("p_type")).alias("category"),
        F.when(key % 5 != 0, F.concat_ws(",", "p_brand", F.lit("x"))).otherwise(" , ").alias("soft_category"),
        F.when(key % 17 == 0, "on request").otherwise(F.col("p_retailprice").cast("string")).alias("price"),
    )
    return catalog.normalise(raw).select(
        "id", "tenant", F.array_join("category", "|").alias("category"), F.size("soft_category").alias("tags"), "price"
    )


@query(
    "product_rows",
    r"""SELECT tenant, id AS product_id, name, price, coalesce(canonical, legacy, 'instock') = 'instock' AS in_stock,
  array_to_string(category, '|') AS categories, array_to_string(soft_category, '|') AS tags, array_to_string(colors, '|') AS colors,
  type, on_sale, CASE WHEN length(c) > 500 THEN left(c, 500) || '…' ELSE c END AS description,
  'https://shop.example/p/' || id AS url, 'https://shop.example/i/' || id AS image
FROM (SELECT *, nullif(trim(regexp_replace(regexp_replace(description, '<[^>]*>', ' ', 'g'), '[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')), '') AS c FROM products_v)""",
)
def product_rows(spark, sf):
    rows = catalog.shaped(bind.products(spark, sf, description=True))
    return rows.select(
        *[F.array_join(c, "|").alias(c) if c in ("categories", "tags", "colors") else c for c in rows.columns]
    )


@query(
    "product_cards",
    """SELECT id AS product_id, name, price, coalesce(canonical, legacy, 'instock') = 'instock' AS in_stock,
  'https://shop.example/p/' || id AS url, 'https://shop.example/i/' || id AS image FROM products_v""",
)
def product_cards(spark, sf):
    rows = bind.products(spark, sf).withColumn("description", F.lit(None).cast("string"))
    return catalog.cards(catalog.shaped(rows))


@query("visible_products", "SELECT id, tenant FROM products_v WHERE hidden IS DISTINCT FROM true")
def visible_products(spark, sf):
    return bind.products(spark, sf).filter(predicates.visible(F.col("hidden"))).select("id", "tenant")


@query(
    "lenient_stock",
    "SELECT id, CASE WHEN canonical IS NOT NULL THEN canonical = 'instock' WHEN legacy IS NOT NULL THEN legacy = 'instock' ELSE true END AS in_stock FROM products_v",
)
def lenient_stock(spark, sf):
    return bind.products(spark, sf).select("id", catalog.in_stock().alias("in_stock"))


@query("strict_stock", "SELECT id FROM products_v WHERE canonical = 'instock'")
def strict_stock(spark, sf):
    rows = bind.products(spark, sf)
    return rows.filter(predicates.strict_stock(F.col("stock_status_canonical"))).select("id")


@query("price_range", "SELECT id, price FROM products_v WHERE price >= 905 AND price <= 1040")
def price_range(spark, sf):
    rows = bind.products(spark, sf)
    return rows.filter(predicates.price_between(F.col("price"), F.lit(905.0), F.lit(1040.0))).select("id", "price")


@query(
    "taxonomy_match",
    """SELECT id, type FROM products_v WHERE (lower(type) LIKE '%econ%' OR 'econ' LIKE '%' || lower(type) || '%'
  OR lower(type) LIKE '%small-sized%' OR 'small-sized' LIKE '%' || lower(type) || '%')
  AND len(list_filter(soft_category, lambda s: contains(lower(s), 'brand#1') OR contains('brand#1', lower(s)) OR contains(lower(s), 're') OR contains('re', lower(s)))) > 0""",
)
def taxonomy_match(spark, sf):
    wanted = lambda *values: F.array(*[F.lit(v) for v in values])
    return bind.products(spark, sf).filter(
        predicates.taxonomy_match(F.col("category"), wanted("Econ", "Small-Sized"))
        & predicates.taxonomy_match(F.col("soft_category"), wanted("BRAND#1", "Re"))
    ).select("id", "type")


@query("category_filter", "SELECT id, type FROM products_v WHERE type IN ('PROMO', 'LARGE')")
def category_filter(spark, sf):
    rows = bind.products(spark, sf)
    return rows.filter(F.arrays_overlap("category", F.array(F.lit("PROMO"), F.lit("LARGE")))).select("id", "type")


@query(
    "filter_cleanup",
    """SELECT event_id AS query_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'x' || k ELSE 'x' || k || '|' || event_type END AS categories,
  CASE WHEN event_id % 4 = 0 THEN event_type END AS type, CASE WHEN event_id % 5 = 0 THEN value END AS price FROM events_v""",
)
def filter_cleanup(spark, sf):
    e, v = bind.events(spark, sf), F.col("event_id")
    word = F.concat(F.lit("x"), F.col("k").cast("string"))
    log = e.select(
        v.alias("query_id"),
        F.when(v % 6 == 0, F.array().cast("array<string>")).when(v % 3 == 0, F.array(F.lit(""), F.lit(" "), F.lit(None)))
        .when(v % 3 == 1, F.array(word, F.lit(""), F.lit(None))).otherwise(F.array(word, F.col("event_type"))).alias("categories"),
        F.when(v % 4 == 0, F.col("event_type")).when(v % 4 == 1, "  ").when(v % 4 == 2, "").alias("type"),
        F.when(v % 5 == 0, F.col("value")).alias("price"),
    )
    clean = fusion.clean_filters(log, lists=["categories"], texts=["type"])
    return clean.select("query_id", F.array_join("categories", "|").alias("categories"), "type", "price")


@query(
    "product_lookup",
    """, asked AS (SELECT DISTINCT tenant, CASE WHEN query_id % 2 = 0 THEN CAST(k + query_id % 7 AS VARCHAR) END AS product_id,
    CASE WHEN query_id % 2 = 1 OR query_id % 10 = 0 THEN query END AS name FROM requests_v)
SELECT a.tenant, a.product_id, a.name, min(p.id) AS found_id FROM asked a LEFT JOIN shown_v p ON p.tenant = a.tenant
  AND (p.id = a.product_id OR contains(lower(p.name), lower(trim(a.name)))) GROUP BY ALL""",
)
def product_lookup(spark, sf):
    q = F.col("query_id")
    lookups = bind.requests(spark, sf).select(
        "tenant",
        F.when(q % 2 == 0, (F.col("k") + q % 7).cast("string")).alias("product_id"),
        F.when((q % 2 == 1) | (q % 10 == 0), F.col("query")).alias("name"),
    )
    return catalog.look_up(lookups, bind.products(spark, sf))


@query(
    "name_lookup",
    """, asked AS (SELECT DISTINCT tenant, lower(trim(query)) AS part FROM requests_v)
SELECT a.tenant, a.part, min(p.id) AS id FROM asked a JOIN shown_v p ON p.tenant = a.tenant AND contains(lower(p.name), a.part) GROUP BY ALL""",
)
def name_lookup(spark, sf):
    lookups = bind.requests(spark, sf).select("tenant", F.col("query").alias("name"))
    return catalog.ids_by_name_part(lookups, bind.products(spark, sf))


@query(
    "ordered_selection",
    """, wanted AS (SELECT event_id AS request_id, unnest(range(0, 6)) AS position, k FROM cart_v),
ids AS (SELECT request_id, position, CAST(k + position % 5 AS VARCHAR) AS product_id FROM wanted)
SELECT i.request_id, CAST(i.position AS INTEGER) AS position, i.product_id, p.name,
  CASE WHEN CAST(i.product_id AS BIGINT) % 2 = 0 THEN 'fits ' || p.name END AS match_reason
FROM ids i JOIN shown_v p ON p.id = i.product_id WHERE p.lenient""",
)
def ordered_selection(spark, sf):
    names = bind.products(spark, sf).select("id", "name")
    hints = (
        bind.cart(spark, sf).select("event_id", F.explode("search_results").alias("id")).join(names, "id")
        .withColumn("hint", F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit(" <b>fits</b>  "), F.col("name"))))
        .filter("hint is not null")
        .groupBy("event_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("id", "hint"))).alias("highlights"))
    )
    asked = bind.cart(spark, sf).join(hints, "event_id", "left").select(
        F.col("event_id").alias("request_id"), "tenant",
        F.concat("search_results", F.slice("search_results", 1, 1)).alias("product_ids"), "highlights",
    )
    products = bind.products(spark, sf).withColumn("description", F.lit(None).cast("string"))
    return catalog.selection(asked, products).select("request_id", "position", "product_id", "name", "match_reason")


@query(
    "category_facets",
    """SELECT tenant, value, products, position FROM (SELECT tenant, type AS value, count(*) AS products,
  CAST(row_number() OVER (PARTITION BY tenant ORDER BY count(*) DESC, type) AS INTEGER) AS position
  FROM shown_v WHERE strict GROUP BY tenant, type) WHERE position <= 60""",
)
def category_facets(spark, sf):
    return catalog.facet(bind.products(spark, sf), "category", catalog.CATEGORY_FACETS)


@query(
    "tag_facets",
    """SELECT tenant, value, products, position FROM (SELECT tenant, value, count(*) AS products,
  CAST(row_number() OVER (PARTITION BY tenant ORDER BY count(*) DESC, value) AS INTEGER) AS position
  FROM (SELECT tenant, unnest(soft_category) AS value FROM shown_v WHERE strict) GROUP BY tenant, value) WHERE position <= 80""",
)
def tag_facets(spark, sf):
    return catalog.facet(bind.products(spark, sf), "soft_category", catalog.TAG_FACETS)


@query(
    "sketched_facets",
    """, v AS (SELECT 'category' AS kind, tenant, type AS value FROM shown_v WHERE strict UNION ALL
  SELECT 'tag', tenant, unnest(soft_category) FROM shown_v WHERE strict),
n AS (SELECT kind, tenant, value, count(*) AS products, CAST(row_number() OVER (PARTITION BY kind, tenant ORDER BY count(*) DESC, value) AS INTEGER) AS position
  FROM v GROUP BY kind, tenant, value)
SELECT kind, tenant, value, products, position FROM n WHERE position <= CASE kind WHEN 'category' THEN 60 ELSE 80 END""",
)
def sketched_facets(spark, sf):
    """The rows of both facets, from frequent-item sketches and exact counts of their candidates."""
    products = bind.products(spark, sf)
    return sketches.facet(products, "category", catalog.CATEGORY_FACETS).select(F.lit("category").alias("kind"), "*").unionByName(
        sketches.facet(products, "soft_category", catalog.TAG_FACETS).select(F.lit("tag").alias("kind"), "*")
    )


@query(
    "price_stats",
    """SELECT tenant, min(price) AS min_price, max(price) AS max_price, count(price) AS priced_products, count(*) AS products
FROM shown_v WHERE strict GROUP BY tenant""",
)
def price_stats(spark, sf):
    return catalog.price_stats(bind.products(spark, sf))


@query(
    "catalog_facets",
    """, v AS (SELECT 'category' AS kind, tenant, type AS value FROM shown_v WHERE strict UNION ALL
  SELECT 'tag', tenant, unnest(soft_category) FROM shown_v WHERE strict),
n AS (SELECT kind, tenant, value, count(*) AS value_count,
  CAST(row_number() OVER (PARTITION BY kind, tenant ORDER BY count(*) DESC, value) AS INTEGER) AS position FROM v GROUP BY kind, tenant, value),
s AS (SELECT tenant, min(price) AS min_price, max(price) AS max_price, count(price) AS priced_products, count(*) AS products
  FROM shown_v WHERE strict GROUP BY tenant)
SELECT n.kind, n.tenant, n.value, n.value_count, n.position, s.min_price, s.max_price, s.priced_products, s.products
FROM n JOIN s USING (tenant) WHERE position <= CASE kind WHEN 'category' THEN 60 ELSE 80 END""",
)
def catalog_facets(spark, sf):
    return catalog.facets(bind.products(spark, sf))


@query(
    "catalog_coverage",
    """SELECT tenant, count(*) AS products, round(count(embedding) / count(*), 6) AS with_vector,
  round(count(price) / count(*), 6) AS with_price, round(count(canonical) / count(*), 6) AS with_stock FROM products_v GROUP BY tenant""",
)
def catalog_coverage(spark, sf):
    return catalog.coverage(bind.products(spark, sf, embedding=True))


# Category phrases of the phrased queries: common table expressions, and the rows they give.
_CATEGORY_CTES = """, asked AS (SELECT DISTINCT tenant, query, list_filter(string_split(regexp_replace(lower(query), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM phrased_v),
grams AS (SELECT DISTINCT tenant, query, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM asked, (SELECT unnest(range(1, 5)) AS n), (SELECT unnest(range(1, 40)) AS i) WHERE i + n - 1 <= len(w)),
vocab AS (SELECT tenant, trim(regexp_replace(lower(value), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) AS phrase, min(value) AS category
  FROM (SELECT tenant, unnest(list_concat(category, soft_category)) AS value FROM products_v) GROUP BY 1, 2)
""".replace("\\\\", "\\")
_CATEGORIES = """SELECT tenant, query, category FROM (SELECT g.tenant, g.query, v.category,
  row_number() OVER (PARTITION BY g.tenant, g.query ORDER BY length(g.phrase) DESC, g.phrase) AS n
  FROM grams g JOIN vocab v USING (tenant, phrase)) WHERE n = 1"""


@query("category_extraction", _CATEGORY_CTES + _CATEGORIES)
def category_extraction(spark, sf):
    return triggers.longest_category(bind.phrased_queries(spark, sf), bind.products(spark, sf))


@query(
    "understood_queries",
    f"""{_CATEGORY_CTES}, found AS ({_CATEGORIES}),
a AS (SELECT DISTINCT tenant, query, v, k FROM phrased_v),
u AS (SELECT a.*, f.category, list_filter(string_split(regexp_replace(lower(coalesce(f.category, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS stop
  FROM a LEFT JOIN found f USING (tenant, query))
SELECT DISTINCT tenant, query, v IN (1, 2, 5, 7) AS hebrew, v IN (0, 6, 7) AS simple, CASE WHEN v IN (1, 7) THEN k + 50.0::DOUBLE END AS price,
  CASE WHEN v IN (2, 4) THEN k + 50.0::DOUBLE END AS price_min, CASE v WHEN 2 THEN 200.0::DOUBLE WHEN 4 THEN 300.0::DOUBLE END AS price_max, category,
  array_to_string(list_filter(string_split(lower(query), ' '), lambda w: w <> '' AND NOT list_contains(stop, w)), ' ') AS cleaned FROM u""",
)
def understood_queries(spark, sf):
    """Script, complexity, price filters, category and cleaned text of every different query."""
    rows = triggers.understood(bind.phrased_queries(spark, sf), bind.products(spark, sf))
    return rows.select("tenant", "query", "hebrew", "simple", "filters.*", "category", "cleaned")


@query(
    "json_export",
    """SELECT id, length(b) AS chars, length(b) > 24000 AS cut, md5(b) AS body_md5 FROM (SELECT id, CASE WHEN length(b) > 24000 THEN left(b, 24000) || '\n…[truncated — narrow the filters or lower the limit]' ELSE b END AS b
  FROM (SELECT CAST(doc_id AS VARCHAR) AS id, '{"id":"' || doc_id || '","text":' || CAST(to_json(text) AS VARCHAR) || '}' AS b FROM documents))""".replace("\\n", "' || chr(10) || '"),
)
def json_export(spark, sf):
    docs = bind.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    size = F.length("body").cast("long")
    return chat.exported(docs, "id", "text").select("id", size.alias("chars"), (size > chat.EXPORT_CHARS).alias("cut"), F.md5("body").alias("body_md5"))


@query(
    "id_guard",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', ':') WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE left(repeat(c_mktsegment, 9), 64) END AS clean FROM customer""",
)
def id_guard(spark, sf):
    c = bind.table(spark, sf, "customer")
    v = F.col("c_custkey") % 4
    raw = (
        F.when(v == 0, F.concat(F.lit("  "), F.replace(F.col("c_name"), F.lit("#"), F.lit(":"))))
        .when(v == 1, F.col("c_name")).when(v == 2, "   ").otherwise(F.repeat("c_mktsegment", F.lit(9)))
    )
    return c.select("c_custkey", text.sanitize_id(raw).alias("clean"))
