"""Failed searches, query understanding, message hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import predicates, text
from vitrine.operators import catalog, triggers
from vitrine.queries.registry import VIEWS, query
from vitrine.sources import bind

LITERAL = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)"

VIEWS.update(
    {
        "items_v": f"""
SELECT q.query_id, q.tenant, q.query, p.number - q.k AS pos, p.id, p.name, p.canonical, p.legacy,
  coalesce(p.canonical, p.legacy, 'instock') = 'instock' AS sellable,
  {LITERAL.format("p.name || ' ' || p.type || ' ' || p.type || ' ' || array_to_string(p.soft_category, ' ')")} AS words
FROM requests_v q JOIN products_v p ON p.number BETWEEN q.k AND q.k + 4
WHERE q.query_id % 6 <> 4 AND (q.query_id % 6 <> 3 OR coalesce(p.canonical, '') = 'outofstock')""",
        "decided_v": f"""
SELECT *, CASE WHEN size = 0 THEN 'no_results' WHEN sellable = 0 THEN 'out_of_stock'
  WHEN NOT literal OR query_id % 6 = 5 THEN 'non_literal' END AS reason
FROM (SELECT q.query_id, q.tenant, q.query, count(i.id) AS size, count(*) FILTER (WHERE i.sellable) AS sellable,
    CASE WHEN q.query_id % 6 = 0 THEN q.query_id % 3 > 0 ELSE coalesce(bool_or(i.id IS NOT NULL AND len(list_filter(q.qw, lambda w: NOT list_contains(i.words, w))) = 0 AND len(q.qw) > 0), false) END AS literal,
    coalesce(string_agg(i.id, '|' ORDER BY i.pos), '') AS product_ids, list(i.name ORDER BY i.pos) FILTER (WHERE i.id IS NOT NULL) AS names
  FROM (SELECT *, {LITERAL.format('query')} AS qw FROM requests_v) q LEFT JOIN items_v i ON i.query_id = q.query_id
  WHERE q.query_id % 6 <> 4 AND length(trim(q.query)) >= 2 GROUP BY q.query_id, q.tenant, q.query)""",
    }
)


@query(
    "response_parsing",
    """SELECT q.query_id, CASE WHEN q.query_id % 6 <> 4 THEN count(i.id) END AS products, q.query_id % 6 = 5 AS is_complex,
  CASE WHEN q.query_id % 6 = 0 THEN CAST(q.query_id % 3 AS DOUBLE) END AS high_text_matches
FROM requests_v q LEFT JOIN items_v i ON i.query_id = q.query_id GROUP BY q.query_id""",
)
def response_parsing(spark, sf):
    rows = triggers.parsed(bind.responses(spark, sf))
    size = F.when(F.col("products").isNotNull(), F.size("products").cast("long"))
    return rows.select("query_id", size.alias("products"), "is_complex", "high_text_matches")


@query(
    "query_gate",
    """SELECT query_id, query FROM (SELECT query_id, query FROM requests_v
  UNION ALL SELECT -query_id, '  ' || left(query, CAST(query_id % 4 AS INTEGER)) || ' ' FROM requests_v) WHERE length(trim(query)) >= 2""",
)
def query_gate(spark, sf):
    """Every request, and each once more when only its first characters are typed (negative id)."""
    log = bind.requests(spark, sf).select("query_id", "query")
    typed = log.select(-F.col("query_id"), F.concat(F.lit("  "), F.expr("left(query, cast(query_id % 4 as int))"), F.lit(" ")))
    return log.union(typed).filter(predicates.long_enough(F.col("query")))


@query("literal_hit", "SELECT query_id, literal FROM decided_v")
def literal_hit(spark, sf):
    return triggers.decisions(triggers.parsed(bind.responses(spark, sf))).select("query_id", "literal")


@query(
    "word_containment",
    f""", w AS (SELECT DISTINCT q.query, p.id, {LITERAL.format('q.query')} AS a, {LITERAL.format("p.name || ' ' || p.type")} AS b
  FROM requests_v q JOIN products_v p ON p.number = q.k)
SELECT query, id, len(a) > 0 AND len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS contained FROM w""",
)
def word_containment(spark, sf):
    asked = bind.requests(spark, sf).select("query", F.col("k").cast("string").alias("id")).distinct()
    own = bind.products(spark, sf).select("id", F.concat_ws(" ", "name", "type").alias("own"))
    hit = triggers.all_words_present(text.literal_words(F.col("query")), text.literal_words(F.col("own")))
    return asked.join(own, "id").select("query", "id", hit.alias("contained"))


@query(
    "trigger_decision",
    """SELECT query_id, tenant, query, literal, reason, 'auto' AS display, product_ids,
  CASE reason WHEN 'no_results' THEN 57 END IS NOT NULL AS empty_result FROM decided_v""",
)
def trigger_decision(spark, sf):
    rows = triggers.decisions(triggers.parsed(bind.responses(spark, sf)))
    return rows.select(
        "query_id", "tenant", "query", "literal", "reason", "display", F.array_join("product_ids", "|").alias("product_ids"),
        (F.coalesce("reason", F.lit("")) == "no_results").alias("empty_result"),
    )


@query(
    "failed_searches",
    """SELECT tenant, reason, count(*) AS searches, count(DISTINCT query) AS queries FROM decided_v
WHERE reason IS NOT NULL AND NOT (reason = 'non_literal' AND query_id % 3 = 0 AND query_id % 5 = 0) GROUP BY tenant, reason""",
)
def failed_searches(spark, sf):
    decided = triggers.decisions(triggers.parsed(bind.responses(spark, sf))).filter("reason is not null")
    kept = triggers.vetoed(decided, bind.review_verdicts(spark, sf))
    return kept.groupBy("tenant", "reason").agg(
        F.count("*").alias("searches"), F.count_distinct("query").alias("queries")
    )


@query(
    "review_veto",
    "SELECT query_id, reason FROM decided_v WHERE reason IS NOT NULL AND NOT (reason = 'non_literal' AND query_id % 3 = 0 AND query_id % 5 = 0)",
)
def review_veto(spark, sf):
    decided = triggers.decisions(triggers.parsed(bind.responses(spark, sf))).filter("reason is not null")
    return triggers.vetoed(decided, bind.review_verdicts(spark, sf)).select("query_id", "reason")


@query(
    "grounding_context",
    """, f AS (SELECT 'c' AS kind, tenant, type AS value FROM shown_v UNION ALL SELECT 't', tenant, unnest(soft_category) FROM shown_v),
n AS (SELECT kind, tenant, value, row_number() OVER (PARTITION BY kind, tenant ORDER BY count(*) DESC, value) AS pos FROM f GROUP BY kind, tenant, value),
g AS (SELECT tenant, string_agg(value, '|' ORDER BY pos) FILTER (WHERE kind = 'c') AS known_category,
  string_agg(value, '|' ORDER BY pos) FILTER (WHERE kind = 't') AS known_tags FROM n WHERE pos <= 30 GROUP BY tenant),
s AS (SELECT tenant, min(price) AS min_price, max(price) AS max_price, count(price) AS priced_products FROM shown_v GROUP BY tenant)
SELECT d.query_id, d.tenant, d.query, array_to_string(names, '|') AS sample_names, known_category, known_tags, min_price, max_price, priced_products
FROM decided_v d JOIN g USING (tenant) JOIN s USING (tenant) WHERE reason = 'non_literal'""",
)
def grounding_context(spark, sf):
    decided = triggers.decisions(triggers.parsed(bind.responses(spark, sf)))
    rows = triggers.grounding(decided, bind.products(spark, sf))
    listed = lambda c, name: F.array_join(c, "|").alias(name)
    return rows.select(
        "query_id", "tenant", "query", listed("sample_names", "sample_names"), listed("known_category", "known_category"),
        listed("known_soft_category", "known_tags"), "min_price", "max_price", "priced_products",
    )


@query(
    "trigger_recovery",
    """, parked AS (SELECT conversation_id, conv_id, turn, CASE WHEN turn = 0 THEN ts - to_minutes(conv_id % 45) ELSE ts END AS parked_at,
  CASE conv_id % 4 WHEN 0 THEN 'no_results' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'non_literal' ELSE 'something_else' END AS r, 'q' || turn AS tq
  FROM chat_v WHERE turn = 0 OR (turn = 2 AND conv_id % 3 = 0)),
m AS (SELECT c.conversation_id, c.turn, arg_max(p.r, p.parked_at) AS r, arg_max(p.tq, p.parked_at) AS tq FROM chat_v c
  LEFT JOIN parked p ON p.conversation_id = c.conversation_id AND p.parked_at <= c.ts AND p.parked_at >= c.ts - INTERVAL 30 MINUTE GROUP BY ALL)
SELECT conversation_id, turn, tq AS trigger_query, CASE WHEN turn % 4 = 1 THEN 'non_literal' WHEN r IN ('no_results', 'out_of_stock', 'non_literal') THEN r END AS reason FROM m""",
)
def trigger_recovery(spark, sf):
    turns = bind.chat_turns(spark, sf).select("conversation_id", "turn", "ts")
    rows = triggers.recovered(turns, bind.parked_triggers(spark, sf))
    from_body = F.when(F.col("turn") % 4 == 1, "non_literal")
    return rows.select(
        "conversation_id", "turn", "trigger_query", triggers.known_reason(F.coalesce(from_body, "trigger_reason")).alias("reason")
    )


@query(
    "query_understanding",
    """, a AS (SELECT DISTINCT tenant, query, v, k, t, p_name FROM phrased_v)
SELECT DISTINCT tenant, query, v IN (1, 2, 5, 7) AS hebrew, v IN (0, 6, 7) AS simple,
  CASE WHEN v = 1 THEN k + 50.0::DOUBLE WHEN v = 7 THEN k + 50.0::DOUBLE END AS price, CASE WHEN v IN (2, 4) THEN k + 50.0::DOUBLE END AS price_min,
  CASE v WHEN 2 THEN 200.0::DOUBLE WHEN 4 THEN 300.0::DOUBLE END AS price_max FROM a""",
)
def query_understanding(spark, sf):
    asked = bind.phrased_queries(spark, sf).select("tenant", "query").distinct()
    q = F.col("query")
    return asked.select(
        "tenant", "query", text.has_hebrew(q).alias("hebrew"), text.is_simple_query(q).alias("simple"),
        text.price_filters(q).alias("p"),
    ).select("tenant", "query", "hebrew", "simple", "p.*")


@query(
    "cleaned_queries",
    """, a AS (SELECT DISTINCT query, v FROM phrased_v), w AS (SELECT query, list_filter(string_split(lower(query), ' '), lambda x: x <> '') AS w FROM a)
SELECT query, array_to_string(list_filter(w, lambda x: x NOT IN ('red', 'for', 'עד', 'שקל')), ' ') AS cleaned FROM w""",
)
def cleaned_queries(spark, sf):
    stop = F.array(*[F.lit(w) for w in ("red", "for", "עד", "שקל")])
    asked = bind.phrased_queries(spark, sf).select("query").distinct()
    return asked.select("query", text.clean_query(F.col("query"), stop).alias("cleaned"))


@query(
    "search_preparation",
    """, a AS (SELECT DISTINCT tenant, query, v, k FROM phrased_v), n AS (SELECT tenant, count(DISTINCT query) AS queries,
  count(DISTINCT query) FILTER (WHERE v IN (0, 6, 7)) AS simple, count(DISTINCT query) FILTER (WHERE v IN (1, 2, 5, 7)) AS hebrew,
  count(DISTINCT query) FILTER (WHERE v IN (1, 2, 4, 7)) AS with_price FROM a GROUP BY tenant) SELECT * FROM n""",
)
def search_preparation(spark, sf):
    asked = bind.phrased_queries(spark, sf)
    understood = triggers.understood(asked, bind.products(spark, sf))
    priced = F.coalesce("filters.price", "filters.price_min", "filters.price_max").isNotNull()
    return understood.groupBy("tenant").agg(
        F.count("*").alias("queries"), F.count_if("simple").alias("simple"), F.count_if("hebrew").alias("hebrew"),
        F.count_if(priced).alias("with_price"),
    )


@query("normalised_text")
def normalised_text(spark, sf):
    """NFKC form of every document, with its code points before and after."""
    docs = bind.table(spark, sf, "documents").select("doc_id", F.length("text").alias("before"), text.normalize_nfkc(F.col("text")).alias("normalised"))
    return docs.withColumn("after", F.length("normalised"))


@query(
    "opening_lines",
    """, o AS (SELECT DISTINCT query, reason FROM decided_v WHERE reason IS NOT NULL)
SELECT query, reason, 'הלקוח חיפש באתר "' || query || '"' || CASE reason WHEN 'no_results' THEN ' ולא הוחזרו לו תוצאות.'
  WHEN 'out_of_stock' THEN ' וכל מה שהתאים אזל מהמלאי.' ELSE ' — שאילתה לא מילולית שהתוצאות שלה לא בהכרח עונות עליה.' END AS opening,
  CASE reason WHEN 'no_results' THEN 'לא מצאתי מוצר שתואם בדיוק למה שחיפשת — אבל בוא נראה יחד מה כן מתאים.'
  WHEN 'out_of_stock' THEN 'מה שחיפשת אזל כרגע מהמלאי. יש כמה דברים דומים שאפשר להשיג — רוצה שאראה לך?'
  ELSE 'החיפוש שלך לא ממש נפתר בשורת חיפוש. ספר לי מה אתה מחפש ואעזור לצמצם.' END AS opener FROM o""",
)
def opening_lines(spark, sf):
    decided = triggers.decisions(triggers.parsed(bind.responses(spark, sf))).filter("reason is not null")
    return decided.select("query", "reason").distinct().select(
        "query", "reason", text.opening_text(F.col("reason"), F.col("query")).alias("opening"),
        text.lookup(text.OPENERS, F.col("reason")).alias("opener"),
    )
