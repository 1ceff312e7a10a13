"""Structured Streaming jobs, each drained over the given tables and checked like a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import experiments
from vitrine.queries.chat import quota_twin
from vitrine.queries.registry import query
from vitrine.session import run_folder
from vitrine.sources import bind
from vitrine.streaming import jobs


def _stream(spark, sf, name):
    bind.pin_utc(spark)
    return jobs.read_table(spark, sf, name)


@query("stream_order_deduplication", "SELECT DISTINCT order_id, total_price FROM deliveries_v")
def stream_order_deduplication(spark, sf):
    orders = bind.order_deliveries(spark, sf, _stream(spark, sf, "orders"))
    kept = jobs.deduplicated_orders(orders).select("order_id", "total_price")
    return jobs.to_table(kept, "orders").drop("batch_number")


@query(
    "stream_daily_counts",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS rule_id, count(*) AS matches FROM events_v GROUP BY ALL",
)
def stream_daily_counts(spark, sf):
    hits = bind.events(spark, sf, _stream(spark, sf, "events")).select("ts", F.col("event_type").alias("rule_id"))
    table = jobs.to_table(jobs.daily_rule_counts(hits), "rule_counts", "update")
    return jobs.latest(table, ["day", "rule_id"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "stream_conversation_sessions",
    """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events_v),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT CAST(user_id AS VARCHAR) AS conversation_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 3 HOUR) AS expires_us, count(*) AS turns FROM s GROUP BY user_id, n""",
)
def stream_conversation_sessions(spark, sf):
    turns = bind.events(spark, sf, _stream(spark, sf, "events")).select("ts", F.col("session_id").alias("conversation_id"))
    # Append would hold back the newest sessions; a drained finite log is read complete.
    table = jobs.last_batch(jobs.to_table(jobs.conversation_sessions(turns), "sessions", "complete"))
    return table.select(
        "conversation_id", F.unix_micros("started").alias("started_us"), F.unix_micros("expires").alias("expires_us"), "turns"
    )


@query(
    "stream_trigger_matches",
    """, p AS (SELECT conversation_id, CASE WHEN turn = 0 THEN ts - to_minutes(conv_id % 45) ELSE ts END AS parked_at FROM chat_v
  WHERE turn = 0 OR (turn = 2 AND conv_id % 3 = 0))
SELECT c.conversation_id, c.turn, epoch_us(max(p.parked_at)) AS parked_us FROM chat_v c LEFT JOIN p ON p.conversation_id = c.conversation_id
  AND c.ts >= p.parked_at AND c.ts <= p.parked_at + INTERVAL 30 MINUTE
GROUP BY c.conversation_id, c.turn""",
)
def stream_trigger_matches(spark, sf):
    turns = bind.chat_turns(spark, sf, _stream(spark, sf, "conversations")).select("conversation_id", "turn", "ts")
    parked = bind.parked_triggers(spark, sf, _stream(spark, sf, "conversations"))
    table = jobs.to_table(jobs.matched_triggers(parked, turns), "trigger_matches")
    newest = table.groupBy("conversation_id", "turn").agg(F.max(F.unix_micros("parked_at")).alias("parked_us"))
    # A turn without a trigger leaves the stream only when the watermark has passed it: the log's last ones do not.
    return bind.chat_turns(spark, sf).select("conversation_id", "turn").join(newest, ["conversation_id", "turn"], "left")


@query(
    "stream_conversation_upsert",
    "SELECT conversation_id, epoch_us(created_at) AS created_us, reason, turns FROM conversations_v",
)
def stream_conversation_upsert(spark, sf):
    writes = bind.conversation_writes(spark, sf, _stream(spark, sf, "conversations"))
    rows = jobs.upserted_conversations(writes, run_folder(spark, "conversations"))
    return rows.select("conversation_id", F.unix_micros("created_at").alias("created_us"), "reason", "turns")


@query(
    "stream_feedback_counts",
    """SELECT conversation_id, count(*) AS events, count(*) FILTER (WHERE event = 'product_click') AS product_clicks,
  count(*) FILTER (WHERE event = 'add_to_cart') AS add_to_carts FROM feedback_v WHERE event <> 'unknown_event' GROUP BY 1""",
)
def stream_feedback_counts(spark, sf):
    stream = bind.feedback(spark, sf, _stream(spark, sf, "events"))
    table = jobs.to_table(jobs.feedback_counts(stream), "feedback", "update")
    return jobs.latest(table, ["conversation_id"])


@query(
    "stream_order_clicks",
    """SELECT o.order_id, epoch_us(k.clicked_at) AS clicked_us FROM rapid_v o JOIN clicks_v k
  ON k.session_id = o.session_id AND k.product_id = o.product_id AND k.clicked_at <= o.created_at AND k.clicked_at >= o.created_at - INTERVAL 30 DAY""",
)
def stream_order_clicks(spark, sf):
    orders = bind.rapid_orders(spark, sf, _stream(spark, sf, "events"))
    clicks = bind.clicks(spark, sf, _stream(spark, sf, "events"))
    table = jobs.to_table(jobs.enriched_orders(orders, clicks, days=30), "order_clicks")
    return table.select("order_id", F.unix_micros("clicked_at").alias("clicked_us"))


@query("stream_exposures", "SELECT tenant, 'exp' || n AS experiment_id, session_id, bucket, arm FROM assigned_v")
def stream_exposures(spark, sf):
    definitions = experiments.read_experiments(bind.experiments(spark, sf))
    bounds = experiments.arm_bounds(definitions)
    requests = bind.requests(spark, sf, _stream(spark, sf, "events"))
    table = jobs.to_table(jobs.first_exposures(requests, definitions, bounds), "exposures")
    first = F.min_by(F.struct("arm", "bucket"), "ts").alias("first")
    return table.groupBy("tenant", "experiment_id", "session_id").agg(first).select("tenant", "experiment_id", "session_id", "first.*")


@query(
    "stream_quota",
    quota_twin("SELECT session_id AS key, event_id AS hit_id, epoch_us(ts) AS hit_at FROM events_v", 3, 86_400),
)
def stream_quota(spark, sf):
    hits = bind.events(spark, sf, _stream(spark, sf, "events")).select(
        F.col("session_id").alias("key"), F.col("event_id").alias("hit_id"), "ts"
    )
    return jobs.to_table(jobs.consumed_quota(hits, 3, 86_400), "quota", state_store=jobs.ROCKSDB).drop("batch_number")
