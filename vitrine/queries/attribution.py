"""Cart and order attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import attribution, sessions
from vitrine.plans import attribution as plans
from vitrine.queries.registry import query
from vitrine.session import run_folder
from vitrine.sources import bind, sinks

AS_OF = "2000-01-01 00:00:00"


@query(
    "tier_membership",
    "SELECT event_id, in_tier1, in_tier2 AS tier2_product, in_tier2 AND NOT in_tier1 AS tier2_upsell FROM cart_v",
)
def tier_membership(spark, sf):
    return attribution.with_tiers(bind.cart(spark, sf)).select("event_id", "in_tier1", "tier2_product", "tier2_upsell")


@query(
    "upsell_rate_by_query",
    """SELECT search_query, count(*) AS total_adds, count(*) FILTER (WHERE in_tier2 AND NOT in_tier1) AS tier2_upsells,
  round(count(*) FILTER (WHERE in_tier2 AND NOT in_tier1) / count(*) * 100, 6) AS tier2_upsell_rate FROM cart_v WHERE in_tier2 IS NOT NULL GROUP BY search_query""",
)
def upsell_rate_by_query(spark, sf):
    return attribution.upsell_rate_by_query(bind.cart(spark, sf))


@query(
    "upsell_revenue",
    """SELECT tenant, CAST(sum(CAST(cart_total AS DECIMAL(18,2))) AS DOUBLE) AS total_cart_value, count(*) AS adds
FROM cart_v WHERE in_tier2 AND NOT in_tier1 GROUP BY tenant""",
)
def upsell_revenue(spark, sf):
    return attribution.upsell_revenue(bind.cart(spark, sf))


@query(
    "adds_by_tier",
    """SELECT tenant, count(*) FILTER (WHERE in_tier1 AND NOT coalesce(in_tier2 AND NOT in_tier1, false)) AS tier1_adds,
  count(*) FILTER (WHERE in_tier2 AND NOT in_tier1) AS tier2_adds FROM cart_v GROUP BY tenant""",
)
def adds_by_tier(spark, sf):
    return attribution.adds_by_tier(bind.cart(spark, sf))


@query(
    "order_ingestion",
    """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, '#' || o_orderkey AS order_number, CAST(o_custkey AS VARCHAR) AS session_id,
  epoch_us(o_orderdate) AS created_us, CAST(o_totalprice AS DECIMAL(18,2)) AS total_price, o_custkey AS customer_id, count(l_orderkey) AS line_count
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_totalprice""",
)
def order_ingestion(spark, sf):
    orders = attribution.parse_orders(bind.order_webhooks(spark, sf))
    lines = F.greatest(F.coalesce(F.size("line_items"), F.lit(0)), F.lit(0)).cast("long")
    return orders.select(
        "order_id", "order_number", "session_id", F.unix_micros("created_at").alias("created_us"), "total_price",
        F.col("customer.id").alias("customer_id"), lines.alias("line_count"),
    )


@query(
    "order_lines",
    """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_partkey AS product_id, CAST(l_linenumber AS BIGINT) AS variant_id,
  CAST(floor(l_quantity) AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def order_lines(spark, sf):
    lines = attribution.order_lines(attribution.parse_orders(bind.order_webhooks(spark, sf)))
    return lines.select("order_id", "product_id", "variant_id", "quantity", "price")


@query(
    "order_deduplication",
    "SELECT order_id, epoch_us(min(received_at)) AS received_us, min(total_price) AS total_price FROM deliveries_v GROUP BY order_id",
)
def order_deduplication(spark, sf):
    rows = attribution.first_deliveries(bind.order_deliveries(spark, sf))
    return rows.select("order_id", F.unix_micros("received_at").alias("received_us"), "total_price")


@query(
    "appended_orders",
    "SELECT order_id, epoch_us(min(received_at)) AS received_us, min(total_price) AS total_price FROM deliveries_v GROUP BY order_id",
)
def appended_orders(spark, sf):
    """The order log after all deliveries have been appended in four batches, in the order they were received."""
    rows = bind.order_deliveries(spark, sf).select("order_id", "received_at", "total_price")
    cuts = rows.agg(F.percentile_approx(F.unix_micros("received_at"), [0.25, 0.5, 0.75])).first()[0] or []
    edges, folder, at = [None, *cuts, None], run_folder(spark, "order-log"), F.unix_micros("received_at")
    for low, high in zip(edges, edges[1:]):
        after = F.lit(True) if low is None else at > low
        sinks.append_new(rows.filter(after & (F.lit(True) if high is None else at <= high)), folder, ["order_id"], ["received_at"], buckets=16)
    log = sinks.read_log(spark, folder, rows.schema)
    return log.select("order_id", F.unix_micros("received_at").alias("received_us"), "total_price")


@query(
    "order_clicks",
    """, c AS (SELECT o.order_id, o.session_id, o.product_id, count(k.click_id) AS matched_clicks, max(epoch_us(k.clicked_at)) AS last_click_us
  FROM rapid_v o LEFT JOIN clicks_v k ON k.session_id = o.session_id AND k.product_id = o.product_id AND k.clicked_at <= o.created_at GROUP BY ALL)
SELECT c.*, coalesce(s.n, 0) AS click_count FROM c LEFT JOIN (SELECT session_id, count(*) AS n FROM clicks_v GROUP BY session_id) s USING (session_id)""",
)
def order_clicks(spark, sf):
    rows = attribution.click_counts(bind.rapid_orders(spark, sf), bind.clicks(spark, sf))
    return rows.select(
        "order_id", "session_id", "product_id", "matched_clicks", F.unix_micros("last_click_at").alias("last_click_us"), "click_count"
    )


@query(
    "matched_clicks",
    """SELECT o.order_id, k.click_id, k.product_id, epoch_us(k.clicked_at) AS clicked_us FROM rapid_v o JOIN clicks_v k
  ON k.session_id = o.session_id AND k.product_id = o.product_id AND k.clicked_at <= o.created_at""",
)
def matched_clicks(spark, sf):
    rows = attribution.matched_click_list(bind.rapid_orders(spark, sf), bind.clicks(spark, sf))
    return rows.select("order_id", "click_id", "product_id", F.unix_micros("clicked_at").alias("clicked_us"))


@query(
    "session_funnel",
    """, a AS (SELECT session_id, count(*) FILTER (WHERE event_type = 'view') AS searches, count(*) FILTER (WHERE event_type = 'click') AS clicks,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events_v WHERE event_type IN ('view', 'click', 'purchase') GROUP BY session_id)
SELECT *, CASE WHEN purchases > 0 THEN 'purchase' WHEN clicks > 0 THEN 'click' ELSE 'search' END AS stage FROM a""",
)
def session_funnel(spark, sf):
    return attribution.funnel(bind.searches(spark, sf), bind.clicks(spark, sf), bind.rapid_orders(spark, sf))


@query(
    "session_slice",
    """SELECT click_id, session_id FROM clicks_v WHERE session_id IN (SELECT session_id FROM events_v WHERE event_type = 'purchase' AND value > 100)""",
)
def session_slice(spark, sf):
    buyers = bind.rapid_orders(spark, sf).filter("total_price > 100")
    return sessions.of_sessions(bind.clicks(spark, sf), buyers).select("click_id", "session_id")


@query(
    "recent_orders",
    "SELECT order_id, tenant FROM deliveries_v WHERE created_at = received_at AND created_at >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY",
)
def recent_orders(spark, sf):
    from vitrine.functions.predicates import recent

    orders = attribution.first_deliveries(bind.order_deliveries(spark, sf))
    return orders.filter(recent(F.col("created_at"), F.lit(AS_OF).cast("timestamp"), 900)).select("order_id", "tenant")


@query(
    "checkout_summary",
    """SELECT tenant, count(*) AS orders, CAST(sum(total_price) AS DECIMAL(18,2)) AS total_revenue,
  CAST(round(CAST(sum(total_price) AS DECIMAL(38,8)) / count(*), 2) AS DECIMAL(18,2)) AS avg_order_value
FROM deliveries_v WHERE created_at = received_at AND created_at >= TIMESTAMP '2000-01-01' - INTERVAL 365 DAY GROUP BY tenant""",
)
def checkout_summary(spark, sf):
    orders = attribution.first_deliveries(bind.order_deliveries(spark, sf))
    return attribution.checkout_summary(orders, F.lit(AS_OF).cast("timestamp"), 365)


@query(
    "newest_orders",
    "SELECT order_id, total_price FROM deliveries_v WHERE created_at = received_at ORDER BY created_at DESC, order_id DESC LIMIT 100",
)
def newest_orders(spark, sf):
    orders = attribution.first_deliveries(bind.order_deliveries(spark, sf))
    return attribution.newest_orders(orders).select("order_id", "total_price")


@query(
    "product_performance",
    """, a AS (SELECT CAST(k AS VARCHAR) AS product_id, count(*) FILTER (WHERE event_type = 'click') AS clicks,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events_v WHERE event_type IN ('click', 'purchase') GROUP BY 1)
SELECT *, purchases = 0 AS never_bought, CASE WHEN clicks > 0 THEN round(purchases / clicks, 6) END AS conversion FROM a""",
)
def product_performance(spark, sf):
    return attribution.product_performance(bind.clicks(spark, sf), bind.rapid_orders(spark, sf))


@query(
    "revenue_by_search",
    """, t AS (SELECT o.order_id, any_value(o.total_price) AS total_price, arg_max(r.query, (r.ts, r.query_id)) AS query
  FROM rapid_v o JOIN requests_v r ON r.session_id = o.session_id AND r.ts <= o.created_at GROUP BY o.order_id)
SELECT query, count(*) AS orders, CAST(sum(CAST(total_price AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue FROM t GROUP BY query""",
)
def revenue_by_search(spark, sf):
    return attribution.revenue_by_search(bind.rapid_orders(spark, sf), bind.searches(spark, sf))


@query(
    "order_attribution",
    """, chain(start_id, id, steps) AS (SELECT old_session_id, new_session_id, 1 FROM aliases_v UNION ALL
  SELECT c.start_id, a.new_session_id, c.steps + 1 FROM chain c JOIN aliases_v a ON a.old_session_id = c.id),
ids AS (SELECT start_id, arg_max(id, steps) AS id FROM chain GROUP BY start_id),
e AS (SELECT coalesce(i.id, v.session_id) AS session_id, event_type FROM events_v v LEFT JOIN ids i ON i.start_id = v.session_id
  WHERE event_type IN ('view', 'click', 'purchase')),
a AS (SELECT session_id, count(*) FILTER (WHERE event_type = 'view') AS searches, count(*) FILTER (WHERE event_type = 'click') AS clicks,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM e GROUP BY session_id)
SELECT *, CASE WHEN purchases > 0 THEN 'purchase' WHEN clicks > 0 THEN 'click' ELSE 'search' END AS stage FROM a""",
)
def order_attribution(spark, sf):
    """Funnel per shopper after old session ids are rewritten to the newest."""
    ids = sessions.canonical_ids(sessions.alias_edges(bind.session_aliases(spark, sf)))
    own = lambda df: sessions.with_canonical(df, ids)
    return attribution.funnel(
        own(bind.searches(spark, sf)), own(bind.clicks(spark, sf)), own(bind.rapid_orders(spark, sf))
    )


@query(
    "attributed_orders",
    """, chain(start_id, id, steps) AS (SELECT old_session_id, new_session_id, 1 FROM aliases_v UNION ALL
  SELECT c.start_id, a.new_session_id, c.steps + 1 FROM chain c JOIN aliases_v a ON a.old_session_id = c.id),
ids AS (SELECT start_id, arg_max(id, steps) AS id FROM chain GROUP BY start_id),
o AS (SELECT order_id, coalesce(i.id, r.session_id) AS session_id, product_id, created_at, total_price FROM rapid_v r LEFT JOIN ids i ON i.start_id = r.session_id),
c AS (SELECT click_id, coalesce(i.id, k.session_id) AS session_id, product_id, clicked_at FROM clicks_v k LEFT JOIN ids i ON i.start_id = k.session_id),
s AS (SELECT query_id, query, coalesce(i.id, r.session_id) AS session_id, ts FROM requests_v r LEFT JOIN ids i ON i.start_id = r.session_id),
k AS (SELECT o.order_id, count(c.click_id) AS matched_clicks, max(epoch_us(c.clicked_at)) AS last_click_us FROM o LEFT JOIN c
  ON c.session_id = o.session_id AND c.product_id = o.product_id AND c.clicked_at <= o.created_at GROUP BY o.order_id),
t AS (SELECT o.order_id, arg_max(s.query, (s.ts, s.query_id)) AS search_query FROM o JOIN s ON s.session_id = o.session_id AND s.ts <= o.created_at GROUP BY o.order_id),
f AS (SELECT session_id, count(*) FILTER (WHERE kind = 1) AS searches, count(*) FILTER (WHERE kind = 2) AS clicks, count(*) FILTER (WHERE kind = 3) AS purchases
  FROM (SELECT session_id, 1 AS kind FROM s UNION ALL SELECT session_id, 2 FROM c UNION ALL SELECT session_id, 3 FROM o) GROUP BY session_id)
SELECT o.order_id, o.session_id, o.product_id, matched_clicks, last_click_us, search_query, searches, clicks, purchases, 'purchase' AS stage,
  CAST(o.total_price AS DECIMAL(18,2)) AS revenue FROM o JOIN k USING (order_id) LEFT JOIN t USING (order_id) JOIN f ON f.session_id = o.session_id""",
)
def attributed_orders(spark, sf):
    """Every tenth order is delivered a second time an hour later."""
    orders = bind.rapid_orders(spark, sf)
    again = F.array_compact(F.array(F.lit(0), F.when(F.col("order_id") % 10 == 0, 1)))
    deliveries = orders.withColumn("late", F.explode(again)).withColumn("received_at", F.col("created_at") + F.make_interval(hours=F.col("late")))
    rows = plans.attributed_orders(deliveries.drop("late"), bind.clicks(spark, sf), bind.searches(spark, sf), bind.session_aliases(spark, sf))
    return rows.select(
        "order_id", "session_id", "product_id", "matched_clicks", F.unix_micros("last_click_at").alias("last_click_us"), "search_query",
        "searches", "clicks", "purchases", "stage", "revenue",
    )
