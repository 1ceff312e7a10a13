"""Registry of queries and the views their SQL twins are written over."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB twin, which may use the views below by name."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix a statement with the views it uses, in dependency order.

    A statement may start with a comma to add views of its own.
    """
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    return f"WITH RECURSIVE {views}\n{sql}"


# Names end in _v so that a view is never confused with a column or a given table.
VIEWS: dict[str, str] = {
    "products_v": """
SELECT CAST(p.p_partkey AS VARCHAR) AS id, 's' || (p.p_partkey % 3) AS tenant,
  p.p_name || ' ' || lower(replace(p.p_brand, '#', ' ')) AS name, p.p_type AS type, d.text AS description,
  [p.p_type] AS category, [split_part(p.p_name, ' ', 1), p.p_brand] AS soft_category,
  CASE WHEN split_part(p.p_name, ' ', 1) IN ('blue', 'red') THEN [split_part(p.p_name, ' ', 1)] ELSE [] END AS colors,
  CASE WHEN p.p_partkey % 17 <> 0 THEN p.p_retailprice END AS price,
  CASE p.p_partkey % 10 WHEN 0 THEN 'outofstock' WHEN 1 THEN NULL ELSE 'instock' END AS canonical,
  CASE WHEN p.p_partkey % 20 = 1 THEN 'outofstock' END AS legacy,
  CASE p.p_partkey % 23 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS hidden,
  p.p_partkey % 7 = 0 AS on_sale, CAST(p.p_size AS DOUBLE) AS boost, p.p_partkey AS number, e.embedding
FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey LEFT JOIN embeddings e ON e.vec_id = p.p_partkey""",
    "shown_v": """
SELECT *, coalesce(canonical, legacy, 'instock') = 'instock' AS lenient,
  coalesce(canonical, '') = 'instock' AS strict FROM products_v WHERE coalesce(hidden, false) = false""",
    "events_v": """
SELECT event_id, ts, user_id, CAST(user_id AS VARCHAR) AS session_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "requests_v": """
SELECT event_id AS query_id, 's' || (k % 3) AS tenant, session_id, ts, k,
  CASE event_id % 5 WHEN 0 THEN name WHEN 1 THEN p_name WHEN 2 THEN left(name, 1) || substr(name, 3)
    WHEN 3 THEN lower(p_type) ELSE 'zzzz qqqq' END AS query,
  CASE WHEN event_id % 60 % 4 = 0 THEN 920.0 END AS price_min,
  CASE WHEN event_id % 60 % 6 = 0 THEN 1050.0 END AS price_max,
  CASE WHEN event_id % 60 % 12 = 1 THEN lower(left(p_type, 4)) END AS category_wish,
  CASE WHEN event_id % 60 % 12 = 2 THEN upper(split_part(p_name, ' ', 1)) END AS tag_wish,
  event_id % 60 % 15 <> 0 AS in_stock,
  CASE event_id % 60 % 7 WHEN 1 THEN 'price_asc' WHEN 2 THEN 'price_desc' END AS sort,
  event_id % 60 % 31 AS lim
FROM events_v JOIN (SELECT *, p_name || ' ' || lower(replace(p_brand, '#', ' ')) AS name FROM part) p ON p.p_partkey = k
WHERE event_type = 'view'""",
    "cart_v": """
SELECT event_id, 's' || (k % 3) AS tenant, session_id, ts, k, 'query ' || (k % 20) AS search_query,
  k + event_id % 9 AS added, k + event_id % 9 BETWEEN k AND k + 4 AS in_tier1,
  CASE WHEN event_id % 4 <> 0 THEN k + event_id % 9 BETWEEN k + 3 AND k + 7 END AS in_tier2, value AS cart_total
FROM events_v WHERE event_type = 'purchase'""",
    "clicks_v": """
SELECT event_id AS click_id, session_id, CAST(k AS VARCHAR) AS product_id, ts AS clicked_at
FROM events_v WHERE event_type = 'click'""",
    "rapid_v": """
SELECT event_id AS order_id, session_id, 's' || (k % 3) AS tenant, CAST(k AS VARCHAR) AS product_id,
  ts AS created_at, value AS total_price FROM events_v WHERE event_type = 'purchase'""",
    "deliveries_v": """
SELECT o_orderkey AS order_id, 's' || (o_custkey % 3) AS tenant, CAST(o_custkey AS VARCHAR) AS session_id,
  o_orderdate AS created_at, o_orderdate + to_hours(n) AS received_at, CAST(o_totalprice AS DECIMAL(18,2)) AS total_price
FROM orders, (SELECT unnest([0, 1]) AS n) WHERE n = 0 OR o_orderkey % 10 = 0""",
    "chat_v": """
SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id, 's' || (conv_id % 3) AS tenant, 'u' || (conv_id % 40) AS session_id,
  turn, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS ts, role, text FROM conversations""",
    "usage_v": """
SELECT conversation_id, conv_id, tenant, session_id, turn, 1 AS rounds,
  greatest(0, length(text) - length(text) % 50) AS input_tokens, turn * 10 + conv_id % 7 AS output_tokens,
  length(text) % 50 AS cache_read_tokens,
  (greatest(0, length(text) - length(text) % 50) * 1.5::DOUBLE + (turn * 10 + conv_id % 7) * 7.5::DOUBLE
    + (length(text) % 50) * 0.15::DOUBLE) / 1000000 AS cost
FROM chat_v WHERE role = 'assistant'""",
    "conversations_v": """
SELECT conversation_id, conv_id, any_value(tenant) AS tenant, CASE WHEN conv_id % 11 <> 0 THEN any_value(session_id) END AS session_id,
  CASE conv_id % 4 WHEN 0 THEN 'no_results' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'non_literal' END AS reason,
  max(turn) + 1 AS turns, min(ts) AS created_at, max(ts) AS updated_at
FROM chat_v GROUP BY conversation_id, conv_id""",
    "feedback_v": """
SELECT CAST(event_id % 100 AS VARCHAR) AS conversation_id, CASE event_type WHEN 'click' THEN 'product_click'
  WHEN 'purchase' THEN 'add_to_cart' WHEN 'view' THEN 'opened' WHEN 'signup' THEN 'helpful' ELSE 'unknown_event' END AS event,
  CAST(k AS VARCHAR) AS product_id, ts AS made_at FROM events_v""",
    "aliases_v": """
SELECT CAST(c_custkey AS VARCHAR) AS old_session_id, CAST(c_custkey + 1 AS VARCHAR) AS new_session_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey) AS ts FROM customer WHERE c_custkey % 5 IN (0, 1)""",
    "phrased_v": """
SELECT event_id, 's' || (k % 3) AS tenant, CASE event_id % 8
  WHEN 0 THEN p_name WHEN 1 THEN t || ' באיזור ה-' || (k + 50) || ' שקל'
  WHEN 2 THEN p_name || ' מ-' || (k + 50) || ' עד 200' WHEN 3 THEN t || ' for dinner around 100 shekel'
  WHEN 4 THEN (k + 50) || ' to 300 ' || p_name WHEN 5 THEN p_name || ' מתאים לארוחת ערב'
  WHEN 6 THEN '  ' || t || ' ' || p_name ELSE 'יין ב-' || (k + 50) END AS query, event_id % 8 AS v, k, t, p_name
FROM events_v JOIN (SELECT *, lower(p_type) AS t FROM part) p ON p.p_partkey = k""",
    "messages_v": """
SELECT 'c-' || conv_id || '-' || turn AS message_id, text FROM conversations
UNION ALL SELECT 'd-' || doc_id, text FROM documents UNION ALL SELECT 'b-' || item_id, text FROM benchmark""",
    "clean_v": r"""
SELECT message_id, text, left(trim(regexp_replace(replace(replace(regexp_replace(text,
  '[\x{0000}-\x{0008}\x{000b}\x{000c}\x{000e}-\x{001f}\x{007f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]', '', 'g'),
  '<', '&lt;'), '>', '&gt;'),
  '[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')), 1000) AS clean
FROM messages_v WHERE length(text) <= 4000""",
}
