"""Lexical, vector and fused retrieval; tiers; pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.functions import matching, text
from vitrine.operators import catalog, completion, fusion, impact, inverted_lists, lexical, names, neighbour_graph, tiers, vector
from vitrine.plans import search
from vitrine.queries.registry import VIEWS, query
from vitrine.session import written
from vitrine.sources import bind

TOKENS = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"

#: Name-match bonus of (tenant, in_stock, query, id, rrf, text_rank, vector_rank) rows.
BONUS = """
SELECT *, CASE WHEN n = '' OR q = '' THEN 0 WHEN n = q THEN 100000 WHEN c <> '' AND n = c THEN 90000 WHEN contains(n, q) THEN 60000
  WHEN c <> '' AND contains(n, c) THEN 50000 WHEN len(w) > 1 AND contains(n, array_to_string(w, ' ')) THEN 40000
  WHEN len(w) > 1 AND hits >= ceil(len(w) * 0.7::DOUBLE) THEN 15000 WHEN len(w) > 1 AND hits >= 2 THEN 12000
  WHEN length(q) >= 3 AND length(n) >= 3 AND (greatest(length(q), length(n30)) - levenshtein(q, n30)) / greatest(length(q), length(n30)) >= 0.75 THEN 10000
  WHEN length(q) >= 3 AND length(n) >= 3 AND len(list_filter(nw, lambda x: length(x) >= 3 AND (greatest(length(q), length(x)) - levenshtein(q, x)) / greatest(length(q), length(x)) >= 0.75)) > 0 THEN 12000
  ELSE 0 END AS bonus
FROM (SELECT *, left(n, 30) AS n30, string_split(n, ' ') AS nw, len(list_filter(w, lambda x: length(x) > 2 AND contains(n, x))) AS hits
  FROM (SELECT {more}p.tenant, p.in_stock, p.query, p.id, p.rrf, p.text_rank, p.vector_rank, lower(trim(c.name)) AS n, lower(p.query) AS q, string_split(lower(p.query), ' ') AS w,
    array_to_string(list_filter(string_split(lower(p.query), ' '), lambda x: x <> 'brand' AND x <> ''), ' ') AS c, c.type, c.soft_category
  FROM {pool} p JOIN products_v c ON c.id = p.id))"""

VIEWS.update(
    {
        "field_text_v": """
SELECT tenant, id, 'name' AS field, name AS txt FROM products_v UNION ALL
SELECT tenant, id, 'category', array_to_string(category, ' ') FROM products_v UNION ALL
SELECT tenant, id, 'soft_category', array_to_string(soft_category, ' ') FROM products_v UNION ALL
SELECT tenant, id, 'description', description FROM products_v WHERE description IS NOT NULL""",
        "words_v": f"SELECT tenant, id, field, {TOKENS.format('txt')} AS w FROM field_text_v",
        "postings_v": """
SELECT tenant, field, token, id, count(*) AS tf, dl FROM (SELECT tenant, id, field, unnest(w) AS token, len(w) AS dl FROM words_v)
GROUP BY tenant, field, token, id, dl""",
        "df_v": "SELECT tenant, field, token, count(*) AS df FROM postings_v GROUP BY tenant, field, token",
        "fields_v": "SELECT tenant, field, count(*) AS docs, sum(len(w)) / count(*) AS avg_dl FROM words_v WHERE len(w) > 0 GROUP BY tenant, field",
        "bm25_v": """
SELECT p.tenant, p.field, p.token, p.id, ln(1 + (f.docs - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE))
  * (p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / f.avg_dl))) AS s
FROM postings_v p JOIN df_v d USING (tenant, field, token) JOIN fields_v f USING (tenant, field)""",
        "asked_v": """
SELECT DISTINCT tenant, in_stock, trim(query) AS query FROM requests_v""",
        "asked_tokens_v": f"""
SELECT DISTINCT tenant, in_stock, query, token FROM (SELECT *, unnest({TOKENS.format('query')}) AS token FROM asked_v)""",
        "reach_v": """
SELECT q.tenant, q.token, d.token AS term, levenshtein(q.token, d.token) AS edits FROM (SELECT DISTINCT tenant, token FROM asked_tokens_v) q
JOIN (SELECT DISTINCT tenant, token FROM df_v) d ON d.tenant = q.tenant AND abs(length(q.token) - length(d.token)) <= 1
WHERE levenshtein(q.token, d.token) <= 1""",
        "token_scores_v": """
SELECT r.tenant, r.token, b.id, sum(b.s * CASE WHEN edits = 0 THEN CASE field WHEN 'name' THEN 8 WHEN 'description' THEN 1 ELSE 4 END
  ELSE CASE field WHEN 'name' THEN 3 WHEN 'description' THEN 0 ELSE 2 END END) AS s
FROM reach_v r JOIN bm25_v b ON b.tenant = r.tenant AND b.token = r.term GROUP BY r.tenant, r.token, b.id""",
        "text_hits_v": """
SELECT tenant, in_stock, query, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant, in_stock, query ORDER BY score DESC, id) - 1 AS rank FROM (
    SELECT a.tenant, a.in_stock, a.query, t.id, round(sum(t.s), 6) AS score FROM asked_tokens_v a
    JOIN token_scores_v t ON t.tenant = a.tenant AND t.token = a.token
    JOIN shown_v p ON p.id = t.id AND (p.lenient OR NOT a.in_stock) WHERE t.s > 0
    GROUP BY a.tenant, a.in_stock, a.query, t.id)) WHERE rank < 80""",
        "query_vectors_v": """
SELECT tenant, query, embedding FROM (SELECT tenant, trim(query) AS query, min(k) AS k FROM requests_v GROUP BY 1, 2)
JOIN embeddings ON vec_id = k WHERE k % 10 <> 2""",
        "vector_hits_v": """
SELECT tenant, in_stock, query, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant, in_stock, query ORDER BY score DESC, id) - 1 AS rank FROM (
    SELECT a.tenant, a.in_stock, a.query, p.id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
    FROM asked_v a JOIN query_vectors_v v USING (tenant, query)
    JOIN shown_v p ON p.tenant = a.tenant AND p.embedding IS NOT NULL AND (p.strict OR NOT a.in_stock))) WHERE rank < 80""",
        "pool_v": """
SELECT tenant, in_stock, query, id, t.rank AS text_rank, v.rank AS vector_rank,
  coalesce(2::DOUBLE / (60 + t.rank + 1), 0) + coalesce(1::DOUBLE / (60 + v.rank + 1), 0) AS rrf
FROM text_hits_v t FULL OUTER JOIN vector_hits_v v USING (tenant, in_stock, query, id)""",
        "specs_v": """
SELECT tenant, trim(query) AS query, price_min, price_max, category_wish, tag_wish, in_stock, sort, lim,
  min(query_id) AS search_id, count(*) AS requests FROM requests_v GROUP BY ALL""",
        "hybrid_v": """
SELECT *, CASE WHEN lim = 0 THEN 12 ELSE greatest(1, least(25, lim)) END AS want,
  count(*) OVER (PARTITION BY search_id) AS total_matched,
  row_number() OVER (PARTITION BY search_id ORDER BY CASE sort WHEN 'price_asc' THEN price WHEN 'price_desc' THEN -price END NULLS LAST,
    rrf DESC, text_rank NULLS LAST, vector_rank NULLS LAST) AS position
FROM (SELECT s.*, p.id, p.rrf, p.text_rank, p.vector_rank, c.price FROM specs_v s JOIN pool_v p USING (tenant, in_stock, query)
  JOIN products_v c ON c.id = p.id
  WHERE (s.price_min IS NULL OR c.price >= s.price_min) AND (s.price_max IS NULL OR c.price <= s.price_max)
    AND (category_wish IS NULL OR contains(lower(c.type), category_wish) OR contains(category_wish, lower(c.type)))
    AND (tag_wish IS NULL OR len(list_filter(c.soft_category, lambda x: contains(lower(x), lower(tag_wish)) OR contains(lower(tag_wish), lower(x)))) > 0)
    AND (NOT s.in_stock OR coalesce(c.canonical, c.legacy, 'instock') = 'instock'))""",
        "bonus_v": BONUS.format(pool="pool_v", more=""),
        "tiered_v": """
SELECT *, row_number() OVER (PARTITION BY tenant, in_stock, query ORDER BY CASE WHEN simple THEN bonus END DESC NULLS LAST,
  CASE WHEN simple THEN least(soft_hits, 2) END DESC NULLS LAST, rrf DESC, text_rank NULLS LAST, vector_rank NULLS LAST) - 1 AS rank
FROM (SELECT *, len(w) BETWEEN 1 AND 3 AS simple, len(list_filter(soft_category, lambda s: list_contains(w, lower(s)))) AS soft_hits FROM bonus_v)""",
        "seeds_v": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant, in_stock, query ORDER BY bonus DESC, rank) AS seed FROM tiered_v WHERE bonus >= 50000) WHERE seed <= 3""",
        "similar_v": """
SELECT tenant, seed_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY tenant, seed_id ORDER BY score DESC, id) AS n FROM (
  SELECT s.tenant, s.id AS seed_id, p.id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
  FROM (SELECT DISTINCT tenant, id FROM seeds_v) s JOIN products_v a ON a.id = s.id AND a.embedding IS NOT NULL
  JOIN products_v p ON p.tenant = a.tenant AND p.type = a.type AND p.id <> a.id AND p.embedding IS NOT NULL AND p.canonical = 'instock')) WHERE n <= 20""",
        "eligible_v": """
SELECT DISTINCT s.tenant, s.in_stock, s.query, p.id, p.strict FROM (SELECT DISTINCT tenant, in_stock, query, type FROM seeds_v) s
JOIN (SELECT DISTINCT tenant, in_stock, query, unnest(soft_category) AS soft FROM tiered_v WHERE rank < 4) b USING (tenant, in_stock, query)
JOIN shown_v p ON p.tenant = s.tenant AND p.type = s.type AND list_contains(p.soft_category, b.soft)""",
        "soft_text_v": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant, in_stock, query ORDER BY score DESC, id) - 1 AS rank FROM (
  SELECT e.tenant, e.in_stock, e.query, e.id, round(sum(t.s), 6) AS score FROM eligible_v e JOIN asked_tokens_v a USING (tenant, in_stock, query)
  JOIN token_scores_v t ON t.tenant = a.tenant AND t.token = a.token AND t.id = e.id JOIN shown_v p ON p.id = e.id AND (p.lenient OR NOT e.in_stock)
  WHERE t.s > 0 GROUP BY e.tenant, e.in_stock, e.query, e.id)) WHERE rank < 80""",
        "soft_vector_v": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant, in_stock, query ORDER BY score DESC, id) - 1 AS rank FROM (
  SELECT e.tenant, e.in_stock, e.query, e.id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) AS score
  FROM eligible_v e JOIN query_vectors_v v USING (tenant, query) JOIN products_v p ON p.id = e.id AND p.embedding IS NOT NULL
  WHERE e.strict OR NOT e.in_stock)) WHERE rank < 80""",
        "soft_v": """
SELECT tenant, in_stock, query, id, coalesce(2::DOUBLE / (60 + t.rank + 1), 0) + coalesce(1::DOUBLE / (60 + v.rank + 1), 0) AS rrf
FROM soft_text_v t FULL OUTER JOIN soft_vector_v v USING (tenant, in_stock, query, id)""",
        "merged_v": """
SELECT tenant, in_stock, query, id, CASE WHEN count(DISTINCT source) = 2 THEN 5000 WHEN min(source) = 'product_similarity' THEN 2500 ELSE 0 END AS boost FROM (
    SELECT tenant, in_stock, query, id, 'soft_category' AS source FROM soft_v
    UNION ALL SELECT s.tenant, s.in_stock, s.query, m.id, 'product_similarity' FROM seeds_v s JOIN similar_v m ON m.tenant = s.tenant AND m.seed_id = s.id)
  GROUP BY tenant, in_stock, query, id""",
        "rest_v": """
SELECT u.*, s.rrf, NULL AS text_rank, NULL AS vector_rank FROM merged_v u LEFT JOIN soft_v s USING (tenant, in_stock, query, id)
WHERE NOT EXISTS (SELECT 1 FROM tiered_v t WHERE t.tenant = u.tenant AND t.in_stock = u.in_stock AND t.query = u.query AND t.id = u.id AND t.rank < 25)""",
        "second_v": f"""
SELECT tenant, in_stock, query, id, boost, rrf, bonus, soft_hits,
  row_number() OVER (PARTITION BY tenant, in_stock, query ORDER BY boost DESC, coalesce(rrf, 0) DESC, bonus DESC, soft_hits DESC, id) - 1 AS rank
FROM (SELECT *, len(list_filter(soft_category, lambda s: list_contains(w, lower(s)))) AS soft_hits FROM ({BONUS.format(pool="rest_v", more="p.boost, ")}))""",
    }
)


def _searches(spark, sf):
    log = bind.requests(spark, sf)
    keyed = log.select("tenant", text.js_trim("query").alias("query"), F.coalesce("in_stock", F.lit(True)).alias("in_stock")).distinct()
    keyed = written(keyed, "searches")  # several branches of a retrieval read them: reduced from the log once
    return keyed.withColumn("lane", fusion.lane(F.col("tenant"), F.col("in_stock")))


_STORED: dict[tuple[str, str], lexical.TextIndex] = {}


def text_index(spark, sf):
    """The catalog's text index, built once per application and catalog and then read back."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = lexical.stored_index(bind.products(spark, sf, description=True))
    return _STORED[key]


_IMPACTS: dict[tuple[str, str], impact.ImpactIndex] = {}


def impact_index(spark, sf):
    """The catalog's impact index, built once per application and catalog and then read back."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _IMPACTS:
        _IMPACTS[key] = impact.build(bind.products(spark, sf), text_index(spark, sf))
    return _IMPACTS[key]


_TRIES: dict[tuple[str, str], DataFrame] = {}


def completion_trie(spark, sf):
    """The catalog's completion trie, built once per application and catalog and then read back."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRIES:
        _TRIES[key] = completion.stored_trie(text_index(spark, sf), bind.products(spark, sf))
    return _TRIES[key]


def _attributes(spark, sf):
    return bind.products(spark, sf, embedding=True)


def _unlaned(df):
    """Lane back to tenant and stock switch, ranks as long."""
    return df.select(
        F.split_part("lane", F.lit("|"), F.lit(1)).alias("tenant"),
        (F.split_part("lane", F.lit("|"), F.lit(2)) == "instock").alias("in_stock"),
        F.col("qid").alias("query"), "id", "score", F.col("rank").cast("long").alias("rank"),
    )


@query("text_postings", "SELECT tenant, field, token, id, tf, dl FROM postings_v")
def text_postings(spark, sf):
    return lexical.postings(bind.products(spark, sf, description=True))


@query(
    "token_statistics",
    "SELECT d.tenant, d.field, d.token, d.df, f.docs, round(f.avg_dl, 6) AS avg_dl FROM df_v d JOIN fields_v f USING (tenant, field)",
)
def token_statistics(spark, sf):
    index = lexical.build_index(bind.products(spark, sf, description=True))
    return index.tokens.join(index.fields, ["tenant", "field"]).withColumn("avg_dl", F.round("avg_dl", 6))


@query(
    "prefix_index",
    """SELECT DISTINCT tenant, field, id, left(token, n) AS prefix FROM postings_v, (SELECT unnest(range(2, 21)) AS n)
WHERE n <= length(token) AND n <= CASE WHEN field IN ('name', 'description') THEN 20 ELSE 15 END""",
)
def prefixtext_index(spark, sf):
    return lexical.prefixes(bind.products(spark, sf, description=True))


@query(
    "prefix_suggestions",
    """, asked AS (SELECT DISTINCT tenant, lower(trim(query)) AS query FROM requests_v),
typed AS (SELECT DISTINCT tenant, trim(left(query, n)) AS prefix FROM (SELECT tenant, query, unnest(range(1, length(query) + 1)) AS n FROM asked)),
grams AS (SELECT DISTINCT tenant, id, field, left(token, n) AS prefix FROM (SELECT *, unnest(range(2, least(length(token), CASE WHEN field IN ('name', 'description') THEN 20 ELSE 15 END) + 1)) AS n FROM postings_v)),
g AS (SELECT p.tenant, t.prefix, p.id, min(CASE p.field WHEN 'name' THEN 0 WHEN 'category' THEN 1 WHEN 'soft_category' THEN 2 ELSE 3 END) AS o
  FROM typed t JOIN grams p ON p.tenant = t.tenant AND p.prefix = t.prefix GROUP BY ALL)
SELECT * FROM (SELECT g.tenant, g.prefix, g.id, CAST(row_number() OVER (PARTITION BY g.tenant, g.prefix ORDER BY o, g.id) AS BIGINT) AS position
  FROM g JOIN shown_v s ON s.id = g.id) WHERE position <= 10""",
)
def prefix_suggestions(spark, sf):
    """Suggestions at every length a query has while it is typed."""
    rows = completion.suggestions(completion.typed(bind.requests(spark, sf)), completion_trie(spark, sf))
    return rows.select("tenant", "prefix", "id", F.col("position").cast("long").alias("position"))


@query(
    "completion_nodes",
    """, grams AS (SELECT DISTINCT tenant, id, CASE field WHEN 'name' THEN 0 WHEN 'category' THEN 1 WHEN 'soft_category' THEN 2 ELSE 3 END AS o, left(token, n) AS prefix
  FROM (SELECT *, unnest(range(2, least(length(token), CASE WHEN field IN ('name', 'description') THEN 20 ELSE 15 END) + 1)) AS n FROM postings_v)),
b AS (SELECT tenant, prefix, id, min(o) AS o FROM grams SEMI JOIN shown_v USING (id) GROUP BY ALL)
SELECT tenant, prefix, length(prefix) AS depth, string_agg(id, ',' ORDER BY o, id) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant, prefix ORDER BY o, id) AS position FROM b) WHERE position <= 10 GROUP BY tenant, prefix""",
)
def completion_nodes(spark, sf):
    """Every node of the completion trie with its best products."""
    nodes = completion_trie(spark, sf)
    return nodes.select("tenant", "prefix", F.length("prefix").cast("long").alias("depth"), F.array_join("best.id", ",").alias("ids"))


@query(
    "fuzzy_tokens",
    """SELECT tenant, token, term AS other, edits FROM reach_v JOIN (SELECT DISTINCT tenant, token AS term FROM df_v WHERE field <> 'description')
USING (tenant, term)""",
)
def fuzzy_tokens(spark, sf):
    words = _searches(spark, sf).select("tenant", F.explode(text.index_tokens(F.col("query"))).alias("token"))
    fuzzy_fields = F.col("field").isin(*lexical.FUZZY_WEIGHT)
    return lexical.one_edit_pairs(words, text_index(spark, sf).tokens.filter(fuzzy_fields))


@query("lexical_retrieval", "SELECT * FROM text_hits_v")
def lexical_retrieval(spark, sf):
    return _unlaned(fusion.text_hits(_searches(spark, sf), bind.products(spark, sf), text_index(spark, sf)))


@query("block_max_retrieval", "SELECT * FROM text_hits_v")
def block_max_retrieval(spark, sf):
    """The same rows as `lexical_retrieval`, from the blocks that can hold them."""
    return _unlaned(fusion.text_hits(_searches(spark, sf), bind.products(spark, sf), impact_index(spark, sf)))


@query("opened_blocks")
def opened_blocks(spark, sf):
    """Of the blocks that hold a term of a query, how many were opened."""
    queries = _searches(spark, sf).select("lane", F.col("query").alias("qid"), "tenant", "query").distinct()
    lanes = fusion.stock_lanes(bind.products(spark, sf), strict=False).select("lane", "tenant", "id")
    return impact.retrieve(queries, lanes, impact_index(spark, sf))[1]


@query("vector_retrieval", "SELECT * FROM vector_hits_v")
def vector_retrieval(spark, sf):
    return _unlaned(fusion.vector_hits(_searches(spark, sf), _attributes(spark, sf), bind.query_vectors(spark, sf)))


_LISTS: dict[tuple[str, str], inverted_lists.VectorLists] = {}


def vector_lists(spark, sf):
    """The catalog's inverted lists, built once per application and catalog and then read back."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LISTS:
        items = fusion.stock_lanes(_attributes(spark, sf).filter("embedding is not null"), strict=True)
        _LISTS[key] = inverted_lists.build(items.select("lane", "id", F.col("embedding").alias("vector")))
    return _LISTS[key]


def _query_vectors(spark, sf):
    searches = _searches(spark, sf).select("lane", "tenant", "query")
    return searches.join(bind.query_vectors(spark, sf), ["tenant", "query"]).select(
        "lane", F.col("query").alias("qid"), F.col("embedding").alias("vector")
    )


@query("approximate_vectors")
def approximate_vectors(spark, sf):
    return _unlaned(inverted_lists.nearest_approx(_query_vectors(spark, sf), vector_lists(spark, sf)))


@query("approximate_recall")
def approximate_recall(spark, sf):
    """How much of the exact neighbours the approximate search finds, per query."""
    exact = fusion.vector_hits(_searches(spark, sf), _attributes(spark, sf), bind.query_vectors(spark, sf))
    return vector.recall(inverted_lists.nearest_approx(_query_vectors(spark, sf), vector_lists(spark, sf)), exact)


@query("pruned_vector_retrieval", "SELECT * FROM vector_hits_v")
def pruned_vector_retrieval(spark, sf):
    """The same rows as `vector_retrieval`, from the lists that can hold them."""
    return _unlaned(inverted_lists.nearest_pruned(_query_vectors(spark, sf), vector_lists(spark, sf))[0])


@query("opened_lists")
def opened_lists(spark, sf):
    """How many of its lists each query of the pruned search opened."""
    return inverted_lists.nearest_pruned(_query_vectors(spark, sf), vector_lists(spark, sf))[1]


def hashed_words(texts):
    """A stand-in embedding service: 16 signed word-hash counts per text."""
    import zlib

    import numpy as np
    import pandas as pd

    def one(value: str):
        out = np.zeros(16, dtype=np.float32)
        for word in value.split():
            h = zlib.crc32(word.encode())
            out[h % 16] += 1.0 if h & 16 else -1.0
        return out

    return pd.Series([one(t) for t in texts])


@query("embedded_queries")
def embedded_queries(spark, sf):
    return vector.embedded(bind.requests(spark, sf), hashed_words)


@query(
    "rank_fusion",
    "SELECT tenant, in_stock, query, id, round(rrf, 9) AS rrf, text_rank, vector_rank FROM pool_v",
)
def rank_fusion(spark, sf):
    return _fused(search.retrieve(_searches(spark, sf), _attributes(spark, sf), bind.query_vectors(spark, sf), text_index(spark, sf)))


@query(
    "pruned_rank_fusion",
    "SELECT tenant, in_stock, query, id, round(rrf, 9) AS rrf, text_rank, vector_rank FROM pool_v",
)
def pruned_rank_fusion(spark, sf):
    """The same pool, from an impact index and inverted lists."""
    return _fused(search.retrieve(
        _searches(spark, sf), _attributes(spark, sf), bind.query_vectors(spark, sf), impact_index(spark, sf), vector_lists(spark, sf)
    ))


def _fused(hits):
    pool = fusion.fuse(*hits)
    return pool.select(
        F.split_part("lane", F.lit("|"), F.lit(1)).alias("tenant"),
        (F.split_part("lane", F.lit("|"), F.lit(2)) == "instock").alias("in_stock"),
        F.col("qid").alias("query"), "id", F.round("rrf", 9).alias("rrf"),
        F.col("text_rank").cast("long").alias("text_rank"), F.col("vector_rank").cast("long").alias("vector_rank"),
    )


@query(
    "hybrid_search",
    """SELECT search_id, requests, h.tenant, h.query, h.in_stock, position, h.id, round(h.rrf, 9) AS rrf, total_matched, least(total_matched, want) AS returned,
  coalesce(n, 0) AS lexical_matches FROM hybrid_v h LEFT JOIN (SELECT tenant, in_stock, query, count(*) AS n FROM text_hits_v GROUP BY ALL) t
  ON t.tenant = h.tenant AND t.in_stock = h.in_stock AND t.query = h.query WHERE position <= want""",
)
def hybrid_search(spark, sf):
    rows = search.hybrid_search(
        bind.requests(spark, sf), _attributes(spark, sf), bind.query_vectors(spark, sf), text_index(spark, sf)
    )
    return rows.select(
        "search_id", "requests", "tenant", "query", "in_stock", F.col("position").cast("long").alias("position"), "id",
        F.round("rrf", 9).alias("rrf"), "total_matched", "returned", "lexical_matches",
    )


@query(
    "routed_search",
    """, bl AS (SELECT tenant, price_min, price_max, category_wish, tag_wish, in_stock, sort, lim, min(-query_id) AS search_id, count(*) AS requests
  FROM requests_v WHERE query_id % 9 = 0 AND query_id > 0 GROUP BY ALL),
br AS (SELECT * FROM (SELECT bl.*, p.id, p.price, row_number() OVER (PARTITION BY search_id ORDER BY
    CASE sort WHEN 'price_asc' THEN coalesce(price, -1e300) WHEN 'price_desc' THEN -coalesce(price, -1e300) END, p.id) - 1 AS rank
  FROM bl JOIN shown_v p ON p.tenant = bl.tenant AND (p.lenient OR NOT bl.in_stock)
  AND (price_min IS NULL OR price >= price_min) AND (price_max IS NULL OR price <= price_max)) WHERE rank < 80),
bf AS (SELECT br.*, CASE WHEN lim = 0 THEN 12 ELSE greatest(1, least(25, lim)) END AS want, count(*) OVER (PARTITION BY search_id) AS total_matched,
  row_number() OVER (PARTITION BY search_id ORDER BY CASE sort WHEN 'price_asc' THEN br.price WHEN 'price_desc' THEN -br.price END NULLS LAST, rank) AS position
  FROM br JOIN products_v c ON c.id = br.id
  WHERE (category_wish IS NULL OR contains(lower(c.type), category_wish) OR contains(category_wish, lower(c.type)))
    AND (tag_wish IS NULL OR len(list_filter(c.soft_category, lambda x: contains(lower(x), lower(tag_wish)) OR contains(lower(tag_wish), lower(x)))) > 0))
SELECT search_id, requests, h.tenant, h.query, h.in_stock, position, h.id, total_matched, least(total_matched, want) AS returned, round(h.rrf, 9) AS rrf,
  coalesce(n, 0) AS lexical_matches, false AS browsed FROM hybrid_v h LEFT JOIN (SELECT tenant, in_stock, query, count(*) AS n FROM text_hits_v GROUP BY ALL) t
  ON t.tenant = h.tenant AND t.in_stock = h.in_stock AND t.query = h.query WHERE position <= want
UNION ALL SELECT search_id, requests, tenant, '', in_stock, position, id, total_matched, least(total_matched, want), NULL, NULL, true FROM bf WHERE position <= want""",
)
def routed_search(spark, sf):
    """The whole log, and every ninth request a second time without its text."""
    log = bind.requests(spark, sf)
    blank = log.filter("query_id % 9 = 0 and query_id > 0").withColumn("query", F.lit("  ")).withColumn("query_id", -F.col("query_id"))
    rows = search.routed_search(log.unionByName(blank), _attributes(spark, sf), bind.query_vectors(spark, sf), text_index(spark, sf))
    return rows.withColumn("rrf", F.round("rrf", 9)).withColumn("position", F.col("position").cast("long"))


@query(
    "catalog_browse",
    """, b AS (SELECT tenant, price_min, price_max, in_stock, sort, min(query_id) AS search_id FROM requests_v GROUP BY ALL)
SELECT search_id, id, rank FROM (SELECT b.search_id, p.id, row_number() OVER (PARTITION BY b.search_id ORDER BY
    CASE sort WHEN 'price_asc' THEN coalesce(price, -1e300) WHEN 'price_desc' THEN -coalesce(price, -1e300) END, p.id) - 1 AS rank
  FROM b JOIN shown_v p ON p.tenant = b.tenant AND (p.lenient OR NOT b.in_stock)
  AND (price_min IS NULL OR price >= price_min) AND (price_max IS NULL OR price <= price_max)) WHERE rank < 80""",
)
def catalog_browse(spark, sf):
    log = bind.requests(spark, sf).withColumn("in_stock", F.coalesce("in_stock", F.lit(True)))
    searches = log.groupBy("tenant", "price_min", "price_max", "in_stock", "sort").agg(F.min("query_id").alias("search_id"))
    return fusion.browse(searches, bind.products(spark, sf)).select(
        F.col("qid").cast("long").alias("search_id"), "id", F.col("rank").cast("long").alias("rank")
    )


@query(
    "price_order",
    """SELECT tenant, id, row_number() OVER (PARTITION BY tenant ORDER BY price NULLS LAST, id) AS cheapest,
  row_number() OVER (PARTITION BY tenant ORDER BY price DESC NULLS LAST, id) AS dearest FROM products_v""",
)
def price_order(spark, sf):
    """Place of every product in both price orders of its store, NULL prices last in both.

    Ranks count what sorts before: price steps are totalled first, so no store is one sort.
    """
    return catalog.price_places(bind.products(spark, sf))


@query(
    "product_alternatives",
    """, near AS (SELECT a.tenant, a.id AS source_id, 'similar_products' AS method, p.id,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6) DESC, p.id) AS position
  FROM products_v a JOIN shown_v p ON p.tenant = a.tenant AND p.id <> a.id AND p.strict AND p.embedding IS NOT NULL WHERE a.embedding IS NOT NULL),
names AS (SELECT DISTINCT tenant, name FROM products_v WHERE embedding IS NULL),
nt AS (SELECT DISTINCT tenant, name, unnest(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS token FROM names),
r AS (SELECT q.tenant, q.token, d.token AS term, levenshtein(q.token, d.token) AS edits FROM (SELECT DISTINCT tenant, token FROM nt) q
  JOIN (SELECT DISTINCT tenant, token FROM df_v) d ON d.tenant = q.tenant AND abs(length(q.token) - length(d.token)) <= 1 WHERE levenshtein(q.token, d.token) <= 1),
ts AS (SELECT r.tenant, r.token, b.id, sum(b.s * CASE WHEN edits = 0 THEN CASE field WHEN 'name' THEN 8 WHEN 'description' THEN 1 ELSE 4 END
  ELSE CASE field WHEN 'name' THEN 3 WHEN 'description' THEN 0 ELSE 2 END END) AS s
  FROM r JOIN bm25_v b ON b.tenant = r.tenant AND b.token = r.term GROUP BY r.tenant, r.token, b.id),
hits AS (SELECT tenant, name, id, row_number() OVER (PARTITION BY tenant, name ORDER BY score DESC, id) AS position FROM (
  SELECT n.tenant, n.name, t.id, round(sum(t.s), 6) AS score FROM nt n JOIN ts t USING (tenant, token) JOIN shown_v p ON p.id = t.id AND p.lenient
  WHERE t.s > 0 GROUP BY n.tenant, n.name, t.id)),
far AS (SELECT s.tenant, s.id AS source_id, 'text_similarity' AS method, h.id, h.position FROM products_v s JOIN hits h ON h.tenant = s.tenant AND h.name = s.name
  WHERE s.embedding IS NULL)
SELECT * FROM (SELECT * FROM near UNION ALL SELECT * FROM far) WHERE position <= 5""",
)
def product_alternatives(spark, sf):
    products = _attributes(spark, sf)
    return catalog.alternatives(products, products, text_index(spark, sf))


_GRAPHS: dict[tuple[str, str, str], DataFrame] = {}


def _graph(spark, sf, name, items):
    """A neighbour graph of the catalog, built once per application and catalog and then read back."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _GRAPHS:
        _GRAPHS[key] = neighbour_graph.build(items)
    return _GRAPHS[key]


def store_graph(spark, sf):
    products = _attributes(spark, sf).select(F.col("tenant").alias("lane"), "id", F.col("embedding").alias("vector"))
    return _graph(spark, sf, "stores", products)


@query("product_neighbours")
def product_neighbours(spark, sf):
    """The links of the neighbour graph of every store."""
    return store_graph(spark, sf).withColumnsRenamed({"lane": "tenant", "id": "source_id", "other": "id"})


@query("graph_alternatives")
def graph_alternatives(spark, sf):
    """`product_alternatives`, the nearest products read from the neighbour graph."""
    products = _attributes(spark, sf)
    return catalog.alternatives(products, products, text_index(spark, sf), graph=store_graph(spark, sf))


@query("graph_recall")
def graph_recall(spark, sf):
    """How many of the exact alternatives of a product the graph finds."""
    products = _attributes(spark, sf)
    found = lambda graph: catalog.alternatives(products, products, text_index(spark, sf), graph=graph).where(
        "method = 'similar_products'"
    ).select(F.col("tenant").alias("lane"), F.col("source_id").alias("qid"), "id")
    return vector.recall(found(store_graph(spark, sf)), found(None)).withColumnsRenamed({"lane": "tenant", "qid": "source_id"})


def _ranked(spark, sf):
    return search.ranked_pool(
        bind.requests(spark, sf), _attributes(spark, sf), bind.query_vectors(spark, sf), text_index(spark, sf)
    )


def _asked(df, *columns):
    """The tenant, stock switch and query of each row, and the columns named."""
    parts = F.split("lane", r"\|")
    return df.select(
        parts[0].alias("tenant"), (parts[1] == "instock").alias("in_stock"), F.col("qid").alias("query"), *columns
    )


@query("name_match_bonus", "SELECT tenant, in_stock, query, id, CAST(bonus AS BIGINT) AS bonus FROM bonus_v")
def name_match_bonus(spark, sf):
    return _asked(_ranked(spark, sf), "id", "bonus")


@query(
    "tiered_search",
    "SELECT tenant, in_stock, query, id, rank, CAST(bonus AS BIGINT) AS bonus, soft_hits, CASE WHEN simple THEN bonus >= 20000 END AS high_text_match FROM tiered_v WHERE rank < 25",
)
def tiered_search(spark, sf):
    return _asked(_ranked(spark, sf).filter("rank < 25"), "id", "rank", "bonus", "soft_hits", "high_text_match")


@query(
    "tier_counts",
    """SELECT tenant, in_stock, query, high_text_matches, other_results, high_text_matches || ' high text matches, ' || other_results || ' related results' AS description
FROM (SELECT tenant, in_stock, query, count(*) FILTER (WHERE bonus >= 20000) AS high_text_matches, count(*) FILTER (WHERE bonus < 20000) AS other_results
  FROM tiered_v WHERE rank < 25 AND simple GROUP BY tenant, in_stock, query)""",
)
def tier_counts(spark, sf):
    counts = tiers.tier_counts(_ranked(spark, sf).filter("rank < 25"))
    return _asked(counts, "high_text_matches", "other_results", "description")


@query("seed_products", "SELECT tenant, in_stock, query, id, CAST(seed AS INTEGER) AS seed FROM seeds_v")
def seed_products(spark, sf):
    return _asked(tiers.seeds(_ranked(spark, sf)), "id", "seed")


@query("seed_neighbours", "SELECT * FROM similar_v")
def seed_neighbours(spark, sf):
    return tiers.similar_to_seeds(tiers.seeds(_ranked(spark, sf)), _attributes(spark, sf))


@query("graph_seed_neighbours")
def graph_seed_neighbours(spark, sf):
    """`seed_neighbours`, read from a neighbour graph of the stores' categories."""
    products = _attributes(spark, sf)
    return tiers.similar_to_seeds(tiers.seeds(_ranked(spark, sf)), products, graph=_graph(spark, sf, "shelves", tiers.shelf_items(products)))


@query(
    "top_soft_categories",
    """SELECT tenant, in_stock, query, array_to_string(list_sort(list(DISTINCT s)), '|') AS wanted_soft
FROM (SELECT tenant, in_stock, query, unnest(soft_category) AS s FROM tiered_v WHERE rank < 4) GROUP BY tenant, in_stock, query""",
)
def top_soft_categories(spark, sf):
    rows = tiers.top_soft_categories(_ranked(spark, sf))
    return _asked(rows, F.array_join("wanted_soft", "|").alias("wanted_soft"))


@query(
    "second_tier",
    "SELECT tenant, in_stock, query, id, CAST(boost AS BIGINT) AS similarity_boost, rank, rank // 20 + 1 AS batch FROM second_v WHERE rank < 65",
)
def second_tier(spark, sf):
    rows = search.expand_second_tier(
        bind.requests(spark, sf), _attributes(spark, sf), bind.query_vectors(spark, sf), text_index(spark, sf)
    )
    return _asked(rows, "id", "similarity_boost", "rank", "batch")


@query(
    "second_tier_categories",
    "SELECT s.tenant, s.in_stock, s.query, p.type AS category, count(*) AS products FROM second_v s JOIN products_v p ON p.id = s.id WHERE rank < 10 GROUP BY ALL",
)
def second_tier_categories(spark, sf):
    rows = search.expand_second_tier(
        bind.requests(spark, sf), _attributes(spark, sf), bind.query_vectors(spark, sf), text_index(spark, sf)
    )
    mix = tiers.category_mix(rows, bind.products(spark, sf))
    return _asked(mix, "category", "products")


@query(
    "result_pages",
    """SELECT tenant, in_stock, query, id, rank, rank // 20 + 1 AS batch, least(65, found) > (rank // 20 + 1) * 20 AS has_more, least(least(65, found), (rank // 20 + 1) * 20) AS total_delivered
FROM (SELECT *, count(*) OVER (PARTITION BY tenant, in_stock, query) AS found FROM tiered_v) WHERE rank < 65""",
)
def result_pages(spark, sf):
    rows = fusion.with_page_state(fusion.paged(_ranked(spark, sf)), ["lane", "qid"])
    return _asked(rows, "id", "rank", "batch", "has_more", "total_delivered")


@query(
    "next_batch",
    "SELECT tenant, in_stock, query, id, rank - 20 AS position FROM tiered_v WHERE rank >= 20 AND rank < 40",
)
def next_batch(spark, sf):
    """Second batch: a fresh ranking without the delivered ids, the next twenty."""
    ranked = _ranked(spark, sf)
    rest = fusion.without_delivered(ranked, ranked.filter("rank < 20"), ["lane", "qid", "id"])
    rows = fusion.renumbered(rest, ["lane", "qid"], "rank").filter(F.col("position") < fusion.PAGE_ROWS)
    return _asked(rows, "id", "position")


@query(
    "external_rerank",
    "SELECT tenant, in_stock, query, id, CASE WHEN rank < 4 THEN 3 - rank ELSE rank END AS final_rank FROM tiered_v WHERE rank < 25",
)
def external_rerank(spark, sf):
    """An outside order that turns the first four results around."""
    ranked = _ranked(spark, sf).filter("rank < 25")
    outside = ranked.filter("rank < 4").select("lane", "qid", "id", (3 - F.col("rank")).alias("new_rank"))
    rows = fusion.reranked(ranked, outside, ["lane", "qid"])
    return _asked(rows, "id", "final_rank")


@query(
    "pinned_results",
    """, pins AS (SELECT 's' || (p_partkey % 3) AS tenant, p_name AS query, CAST(p_partkey AS VARCHAR) AS id,
    row_number() OVER (PARTITION BY p_partkey % 3, p_name ORDER BY p_partkey DESC) AS pin_position FROM part),
k AS (SELECT * FROM pins WHERE pin_position <= 3),
m AS (SELECT tenant, in_stock, query, id, min(rank) AS rank, min(pin_position) AS pin FROM (
  SELECT tenant, in_stock, query, id, rank, NULL AS pin_position FROM tiered_v WHERE rank < 25 UNION ALL
  SELECT tenant, in_stock, query, id, NULL, pin_position FROM k JOIN (SELECT DISTINCT tenant, in_stock, query FROM tiered_v) USING (tenant, query)) GROUP BY ALL)
SELECT tenant, in_stock, query, id, row_number() OVER (PARTITION BY tenant, in_stock, query ORDER BY pin NULLS LAST, rank NULLS LAST, id) AS position FROM m""",
)
def pinned_results(spark, sf):
    ranked = _asked(_ranked(spark, sf).filter("rank < 25"), "id", F.col("rank").cast("int").alias("rank"))
    rows = fusion.pinned_first(ranked, bind.name_pins(spark, sf))
    return rows.select("tenant", "in_stock", "query", "id", F.col("position").cast("long").alias("position"))


@query("traffic_bucket", """SELECT session_id, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('exp1:' || session_id, ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id FROM events)""")
def traffic_bucket(spark, sf):
    sessions = bind.events(spark, sf).select("session_id").distinct()
    return sessions.select("session_id", matching.traffic_bucket(F.lit("exp1"), F.col("session_id")).alias("bucket"))


@query(
    "edit_similarity",
    """, q AS (SELECT DISTINCT lower(query) AS query, k FROM requests_v)
SELECT q.query, q.k, levenshtein(q.query, lower(p.p_name)) AS edits,
  round((greatest(length(q.query), length(p.p_name)) - levenshtein(q.query, lower(p.p_name))) / greatest(length(q.query), length(p.p_name)), 6) AS similarity
FROM q JOIN part p ON p.p_partkey = q.k""",
)
def edit_similarity(spark, sf):
    asked = bind.requests(spark, sf).select(F.lower("query").alias("query"), "k").distinct()
    names = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.lower("p_name").alias("name"))
    return asked.join(names, "k").select(
        "query", "k", F.levenshtein("query", "name").cast("long").alias("edits"),
        F.round(matching.similarity(F.col("query"), F.col("name")), 6).alias("similarity"),
    )


@query(
    "similar_names",
    """, q AS (SELECT DISTINCT tenant, lower(trim(query)) AS query FROM requests_v), n AS (SELECT DISTINCT tenant, lower(name) AS name FROM products_v)
SELECT tenant, query, name, edits, round((longer - edits) / longer, 6) AS similarity FROM (
  SELECT q.tenant, q.query, n.name, levenshtein(q.query, n.name) AS edits, greatest(length(q.query), length(n.name)) AS longer
  FROM q JOIN n ON n.tenant = q.tenant AND q.query <> '' AND n.name <> '') WHERE (longer - edits) / longer >= 0.75""",
)
def similar_names(spark, sf):
    """All products whose name is a quarter or less away from something that was asked for, pool or no pool."""
    asked = bind.requests(spark, sf).select("tenant", text.js_trim("query").alias("query"))
    return names.similar(asked, bind.products(spark, sf).select("tenant", "name"))
