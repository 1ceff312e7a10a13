"""Cart additions and orders traced back to searches, clicks and result tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine import schemas
from vitrine.functions import predicates
from vitrine.operators.running import as_of, with_running

LISTED_ORDERS = 100


def with_tiers(cart: DataFrame) -> DataFrame:
    """Was the added product shown in tier one, in tier two, only in tier two (NULL: unknown)."""
    one = F.array_contains("search_results", F.col("product_id"))
    two = F.array_contains("tier2_results", F.col("product_id"))
    return (
        cart.withColumn("in_tier1", F.coalesce(one, F.lit(False)))
        .withColumn("tier2_product", two)
        .withColumn("tier2_upsell", F.col("tier2_product") & ~F.col("in_tier1"))
    )


def upsell_rate_by_query(cart: DataFrame) -> DataFrame:
    known = with_tiers(cart).filter("tier2_product is not null")
    counts = known.groupBy("search_query").agg(
        F.count("*").alias("total_adds"), F.count_if("tier2_upsell").alias("tier2_upsells")
    )
    return counts.withColumn("tier2_upsell_rate", F.round(F.col("tier2_upsells") / F.col("total_adds") * 100, 6))


def upsell_revenue(cart: DataFrame) -> DataFrame:
    return with_tiers(cart).filter("tier2_upsell").groupBy("tenant").agg(
        F.round(F.sum(F.col("cart_total").cast("decimal(18,2)")), 2).cast("double").alias("total_cart_value"),
        F.count("*").alias("adds"),
    )


def adds_by_tier(cart: DataFrame) -> DataFrame:
    rows = with_tiers(cart)
    return rows.groupBy("tenant").agg(
        F.count_if(F.col("in_tier1") & ~F.coalesce("tier2_upsell", F.lit(False))).alias("tier1_adds"),
        F.count_if(F.coalesce("tier2_upsell", F.lit(False))).alias("tier2_adds"),
    )


def parse_orders(webhooks: DataFrame, column: str = "body") -> DataFrame:
    """Order JSON to flat orders: money as decimals, session id from the note attributes."""
    o = webhooks.select(F.from_json(column, schemas.ORDER_WEBHOOK).alias("o"))
    session = F.get(F.filter("o.note_attributes", lambda n: n["name"] == "session_id"), F.lit(0))["value"]
    money = lambda name: F.col(f"o.{name}").try_cast("decimal(18,2)")
    return o.select(
        F.col("o.id").cast("string").alias("order_id"),
        F.col("o.name").alias("order_number"),
        session.alias("session_id"),
        F.col("o.created_at").alias("created_at"),
        money("total_price").alias("total_price"),
        money("subtotal_price").alias("subtotal_price"),
        money("total_tax").alias("total_tax"),
        F.col("o.currency").alias("currency"),
        F.col("o.customer").alias("customer"),
        F.col("o.line_items").alias("line_items"),
    )


def order_lines(orders: DataFrame) -> DataFrame:
    return orders.select("order_id", "session_id", "created_at", F.inline("line_items")).withColumn(
        "price", F.col("price").try_cast("decimal(18,2)")
    )


def first_deliveries(deliveries: DataFrame) -> DataFrame:
    """One row per order id, the first received; partial per map task, so redeliveries stay cheap."""
    others = [c for c in deliveries.columns if c != "order_id"]
    first = F.min_by(F.struct(*others), F.col("received_at"))
    return deliveries.groupBy("order_id").agg(first.alias("first")).select("order_id", "first.*")


def click_counts(orders: DataFrame, clicks: DataFrame) -> DataFrame:
    """Per order line: clicks of its session on its product at or before the order.

    Counts, first and last click come from running totals, so a session with very many clicks and
    orders costs its rows, not their product. ``matched_upto`` numbers the session's clicks on the
    product in time order: the matched clicks are those numbered 1 to ``matched_clicks``.
    """
    keys = ["session_id", "product_id"]
    both = clicks.select(*keys, F.col("clicked_at").alias("ts"), F.lit(0).alias("side"), F.col("click_id").alias("row_id")).unionByName(
        orders.select(*keys, F.col("created_at").alias("ts"), F.lit(1).alias("side"), F.col("order_id").alias("row_id"))
    )
    is_click = F.col("side") == 0
    run = with_running(
        both, keys, F.date_trunc("day", "ts"), ["ts", "side", "row_id"],
        sums={"matched_clicks": is_click.cast("long")},
        lasts={"last_click_at": (is_click, F.col("ts"))},
    )
    per_session = clicks.groupBy("session_id").agg(F.count("*").alias("click_count"))
    return (
        run.filter("side = 1")
        .select("session_id", "product_id", F.col("row_id").alias("order_id"), "matched_clicks", "last_click_at")
        .join(per_session, "session_id", "left")
        .withColumn("click_count", F.coalesce("click_count", F.lit(0)))
    )


def matched_click_list(orders: DataFrame, clicks: DataFrame) -> DataFrame:
    """The matched clicks themselves, one row per order line and click (flat, never nested)."""
    return orders.join(clicks, ["session_id", "product_id"]).filter("clicked_at <= created_at")


def funnel(searches: DataFrame, clicks: DataFrame, orders: DataFrame) -> DataFrame:
    """Searches, clicks and purchases per session, and the furthest stage reached."""
    side = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    joined = (
        side(searches, "searches")
        .join(side(clicks, "clicks"), "session_id", "full_outer")
        .join(side(orders, "purchases"), "session_id", "full_outer")
        .na.fill(0, ["searches", "clicks", "purchases"])
    )
    stage = F.when(F.col("purchases") > 0, "purchase").when(F.col("clicks") > 0, "click").otherwise("search")
    return joined.withColumn("stage", stage)


def checkout_summary(orders: DataFrame, as_of_ts, days: int) -> DataFrame:
    """Orders, revenue and average order value per tenant over the last days."""
    recent = orders.filter(predicates.recent(F.col("created_at"), as_of_ts, days))
    return recent.groupBy("tenant").agg(
        F.count("*").alias("orders"),
        F.sum("total_price").cast("decimal(18,2)").alias("total_revenue"),
        F.round(F.sum("total_price") / F.count("*"), 2).cast("decimal(18,2)").alias("avg_order_value"),
    )


def newest_orders(orders: DataFrame, limit: int = LISTED_ORDERS) -> DataFrame:
    return orders.orderBy(F.desc("created_at"), F.desc("order_id")).limit(limit)


def product_performance(clicks: DataFrame, purchases: DataFrame) -> DataFrame:
    side = lambda df, name: df.groupBy("product_id").agg(F.count("*").alias(name))
    joined = side(clicks, "clicks").join(side(purchases, "purchases"), "product_id", "full_outer").na.fill(
        0, ["clicks", "purchases"]
    )
    return joined.withColumn("never_bought", F.col("purchases") == 0).withColumn(
        "conversion", F.round(F.col("purchases") / F.nullif("clicks", F.lit(0)), 6)
    )


def revenue_by_search(orders: DataFrame, searches: DataFrame) -> DataFrame:
    """Order revenue credited to the session's last search at or before the order."""
    searched = searches.withColumnRenamed("ts", "searched_at")
    touched = as_of(orders, searched, ["session_id"], "created_at", "searched_at", "query_id", ["query"])
    return touched.filter("query is not null").groupBy("query").agg(
        F.count("*").alias("orders"),
        F.sum(F.col("total_price").cast("decimal(18,2)")).cast("decimal(18,2)").alias("revenue"),
    )
