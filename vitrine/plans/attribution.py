"""Order attribution as one job: deliveries, identity, matched clicks, last search, funnel, revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.operators import attribution, sessions
from vitrine.operators.running import as_of
from vitrine.session import checkpointed


def attributed_orders(deliveries: DataFrame, clicks: DataFrame, searches: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per order: its shopper's newest session id, matched clicks, last search, funnel counts, revenue.

    ``deliveries(order_id, session_id, product_id, created_at, received_at, total_price)`` may repeat an
    order; the first received counts. ``aliases`` holds session rewrites; all three logs follow them.
    """
    ids = checkpointed(sessions.canonical_ids(sessions.alias_edges(aliases)))
    orders = checkpointed(sessions.with_canonical(attribution.first_deliveries(deliveries), ids))
    clicked, searched = sessions.with_canonical(clicks, ids), sessions.with_canonical(searches, ids)
    matched = attribution.click_counts(orders, clicked).select("order_id", "matched_clicks", "last_click_at")
    touched = as_of(
        orders.select("order_id", "session_id", "product_id", "created_at", "total_price"),
        searched.select("session_id", F.col("ts").alias("searched_at"), "query_id", F.col("query").alias("search_query")),
        ["session_id"], "created_at", "searched_at", "query_id", ["search_query"],
    ).drop("matched_searched_at")
    stages = attribution.funnel(searched, clicked, orders)
    return (
        touched.join(matched, "order_id", "left")
        .join(stages, "session_id")
        .withColumn("revenue", F.col("total_price").cast("decimal(18,2)"))
    )
