"""Message hygiene, chat accounting, quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import text
from vitrine.operators import chat, quota, sketches
from vitrine.queries.registry import VIEWS, query
from vitrine.sources import bind

AS_OF = "2024-01-15 00:00:00"
OVERRIDES = "(?i)(" + "|".join(text.OVERRIDE_PATTERNS) + ")"

VIEWS.update(
    {
        "stats_v": """
SELECT c.*, coalesce(u.cost, 0) AS estimated_cost, u.input_tokens, u.output_tokens, u.cache_read_tokens FROM conversations_v c LEFT JOIN (
  SELECT conversation_id, sum(round(cost, 8)) AS cost, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
    sum(cache_read_tokens) AS cache_read_tokens FROM usage_v GROUP BY conversation_id) u USING (conversation_id)
WHERE created_at >= TIMESTAMP '2024-01-15' - INTERVAL 30 DAY""",
    }
)


def quota_twin(hits: str, limit: int, seconds: int) -> str:
    """SQL for first-hit-anchored windows: openings by a fold over each key's ordered times."""
    return f""", h AS ({hits}), f AS (SELECT key, list_reduce(list_transform(list(hit_at ORDER BY hit_at), lambda x: [x]),
  lambda acc, x: CASE WHEN x[1] >= acc[len(acc)] + {seconds * 1_000_000} THEN list_append(acc, x[1]) ELSE acc END) AS o FROM h GROUP BY key),
o AS (SELECT key, unnest(o) AS opened FROM f),
n AS (SELECT h.key, h.hit_id, h.hit_at, max(o.opened) AS opened FROM h JOIN o ON o.key = h.key AND o.opened <= h.hit_at GROUP BY ALL)
SELECT key, hit_id, opened, row_number() OVER (PARTITION BY key, opened ORDER BY hit_at, hit_id) AS count,
  row_number() OVER (PARTITION BY key, opened ORDER BY hit_at, hit_id) <= {limit} AS allowed FROM n"""


# Junk class of a text by its letters and words.
_JUNK = """CASE WHEN letters = 0 THEN 'no_letters' WHEN letters / length(clean) < 0.35 THEN 'symbol_soup'
  WHEN len(list_filter(range(1, length(clean) - 8), lambda i: substr(clean, i, 10) = repeat(substr(clean, i, 1), 10))) > 0 THEN 'repeated_char'
  WHEN len(words) > 3 AND len(list_distinct(list_transform(words, lambda w: lower(w)))) = 1 THEN 'repeated_word'
  WHEN len(list_filter(words, lambda w: length(w) > 60)) > 0 THEN 'long_token' END"""


@query("sanitised_messages", "SELECT message_id, clean FROM clean_v")
def sanitised_messages(spark, sf):
    rows = bind.messages(spark, sf).filter(text.utf16_length(F.col("text")) <= chat.REJECT_CHARS)
    return rows.select("message_id", text.sanitize(F.col("text")).alias("clean"))


@query("oversize_messages", "SELECT message_id FROM messages_v WHERE length(text) > 4000")
def oversize_messages(spark, sf):
    return chat.oversize(bind.messages(spark, sf)).select("message_id")


@query(
    "message_junk",
    r""", l AS (SELECT message_id, clean, length(regexp_replace(clean, '[^\p{L}\p{N}]', '', 'g')) AS letters,
  list_filter(string_split(clean, ' '), lambda w: w <> '') AS words FROM clean_v WHERE clean <> '')
SELECT message_id, """ + _JUNK + r""" AS junk FROM l""",
)
def message_junk(spark, sf):
    return chat.audited(bind.messages(spark, sf)).filter(text.has_content(F.col("text"))).select("message_id", "junk")


@query("override_attempts", f"SELECT message_id, regexp_matches(clean, '{OVERRIDES}') AS override_attempt FROM clean_v")
def override_attempts(spark, sf):
    return chat.audited(bind.messages(spark, sf)).select("message_id", "override_attempt")


@query(
    "canned_replies",
    """, u AS (SELECT event_id, event_type, event_id % 5 AS v, k FROM events_v)
SELECT event_id, CASE v WHEN 0 THEN 'no_letters' WHEN 1 THEN 'symbol_soup' WHEN 2 THEN 'repeated_char' WHEN 3 THEN 'repeated_word' ELSE 'long_token' END AS junk,
  CASE v WHEN 4 THEN 'ההודעה נראית כמו טקסט שהודבק בטעות. אפשר לכתוב בקצרה מה אתה מחפש?' ELSE 'לא הצלחתי להבין את ההודעה. אפשר לכתוב במילים מה אתה מחפש?' END AS reply FROM u""",
)
def canned_replies(spark, sf):
    """Junk of every class made from the event log, and the reply each class gets."""
    v, word = F.col("event_id") % 5, F.col("event_type")
    made = (
        F.when(v == 0, "?!. !!").when(v == 1, F.concat(word, F.repeat(F.lit("#"), F.lit(40))))
        .when(v == 2, F.concat(word, F.repeat(F.lit("a"), F.lit(11)))).when(v == 3, F.concat_ws(" ", word, F.upper(word), word, word))
        .otherwise(F.concat(F.lit("see "), F.repeat(word, F.lit(16))))
    )
    rows = bind.events(spark, sf).select("event_id", made.alias("text"))
    return chat.audited(rows).select("event_id", "junk", "reply")


@query(
    "message_audit",
    f""", j AS (SELECT message_id, regexp_matches(clean, '{OVERRIDES}') AS o, clean = '' AS e FROM clean_v)
SELECT split_part(message_id, '-', 1) AS source, count(*) AS messages, count(*) FILTER (WHERE o) AS override_attempts, count(*) FILTER (WHERE e) AS empty FROM j GROUP BY 1""",
)
def message_audit(spark, sf):
    rows = chat.audited(bind.messages(spark, sf))
    return rows.groupBy(F.split_part("message_id", F.lit("-"), F.lit(1)).alias("source")).agg(
        F.count("*").alias("messages"), F.count_if("override_attempt").alias("override_attempts"),
        F.count_if(F.col("clean") == "").alias("empty"),
    )


@query(
    "turn_numbers",
    """SELECT conversation_id, turn, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS turn_number,
  row_number() OVER (PARTITION BY conversation_id ORDER BY turn) > 30 AS rejected FROM chat_v WHERE role = 'user'""",
)
def turn_numbers(spark, sf):
    return chat.numbered_turns(bind.chat_turns(spark, sf)).select("conversation_id", "turn", "turn_number", "rejected")


@query(
    "conversation_guard",
    "SELECT conversation_id, turn, conv_id % 7 = 0 OR conv_id % 5 = 0 OR conv_id % 9 = 0 AS is_new FROM chat_v",
)
def conversation_guard(spark, sf):
    turns = bind.chat_turns(spark, sf)
    n = F.col("conversation_id").cast("long")
    stored = chat.latest_conversations(bind.conversation_writes(spark, sf)).filter(n % 9 != 0).select(
        "conversation_id",
        F.when(n % 7 == 0, "other").otherwise(F.col("tenant")).alias("tenant"),
        F.when(n % 5 == 0, "old").otherwise("current").alias("provider"),
    )
    rows = chat.guarded_turns(turns.withColumn("provider", F.lit("current")), stored)
    return rows.select("conversation_id", "turn", "is_new")


@query(
    "turn_usage",
    "SELECT conversation_id, turn, CAST(rounds AS BIGINT) AS rounds, input_tokens, output_tokens, cache_read_tokens, round(cost, 8) AS cost_usd FROM usage_v",
)
def turn_usage(spark, sf):
    rows = chat.turn_costs(chat.turn_usage(bind.model_rounds(spark, sf)))
    return rows.select("conversation_id", "turn", "rounds", "input_tokens", "output_tokens", "cache_read_tokens", "cost_usd")


@query(
    "running_cost",
    """SELECT conversation_id, turn, CAST(sum(input_tokens) OVER w AS BIGINT) AS total_input, CAST(sum(output_tokens) OVER w AS BIGINT) AS total_output,
  round(sum(cost) OVER w, 8) AS total_cost_usd FROM usage_v WINDOW w AS (PARTITION BY conversation_id ORDER BY turn)""",
)
def running_cost(spark, sf):
    rows = chat.running_costs(chat.turn_usage(bind.model_rounds(spark, sf)))
    return rows.select("conversation_id", "turn", "total_input", "total_output", "total_cost_usd")


@query(
    "conversation_upsert",
    "SELECT conversation_id, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us, session_id, reason, turns FROM conversations_v",
)
def conversation_upsert(spark, sf):
    rows = chat.latest_conversations(bind.conversation_writes(spark, sf))
    return rows.select(
        "conversation_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"),
        "session_id", "reason", "turns",
    )


@query("accepted_feedback", "SELECT conversation_id, event, product_id, epoch_us(made_at) AS at_us FROM feedback_v WHERE event <> 'unknown_event'")
def accepted_feedback(spark, sf):
    rows = chat.accepted_feedback(bind.feedback(spark, sf))
    return rows.select("conversation_id", "event", "product_id", F.unix_micros("at").alias("at_us"))


@query(
    "engagement_counts",
    """, f AS (SELECT conversation_id, count(*) AS events, count(*) FILTER (WHERE event = 'product_click') AS product_clicks,
  count(*) FILTER (WHERE event = 'add_to_cart') AS add_to_carts, min(made_at) AS made_at FROM feedback_v WHERE event <> 'unknown_event' GROUP BY 1)
SELECT conversation_id, epoch_us(coalesce(c.created_at, f.made_at)) AS created_us, reason, coalesce(events, 0) AS events,
  coalesce(product_clicks, 0) AS product_clicks, coalesce(add_to_carts, 0) AS add_to_carts FROM conversations_v c FULL OUTER JOIN f USING (conversation_id)""",
)
def engagement_counts(spark, sf):
    rows = chat.upserted_with_feedback(chat.latest_conversations(bind.conversation_writes(spark, sf)), bind.feedback(spark, sf))
    return rows.select("conversation_id", F.unix_micros("created_at").alias("created_us"), "reason", "events", "product_clicks", "add_to_carts")


def _stats(spark, sf):
    conversations = chat.latest_conversations(bind.conversation_writes(spark, sf))
    return chat.conversation_stats(conversations, chat.turn_usage(bind.model_rounds(spark, sf)))


@query(
    "stats_by_reason",
    """SELECT tenant, reason, count(*) AS conversations, CAST(sum(turns) AS BIGINT) AS turns, round(sum(estimated_cost), 6) AS estimated_cost_usd
FROM stats_v GROUP BY tenant, reason""",
)
def stats_by_reason(spark, sf):
    return chat.by_reason(_stats(spark, sf), F.lit(AS_OF).cast("timestamp"))


@query(
    "stats_totals",
    """SELECT tenant, count(*) AS conversations, CAST(sum(turns) AS BIGINT) AS turns, round(sum(estimated_cost), 6) AS estimated_cost_usd,
  CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
  CAST(sum(coalesce(cache_read_tokens, 0)) AS BIGINT) AS cache_read_tokens FROM stats_v GROUP BY tenant""",
)
def stats_totals(spark, sf):
    return chat.totals(_stats(spark, sf), F.lit(AS_OF).cast("timestamp"))


@query("distinct_shoppers", "SELECT tenant, count(DISTINCT session_id) AS unique_shoppers FROM conversations_v GROUP BY tenant")
def distinct_shoppers(spark, sf):
    return chat.distinct_shoppers(chat.latest_conversations(bind.conversation_writes(spark, sf)))


_MONTHS = """, days AS (SELECT DISTINCT tenant, session_id, CAST(ts AS DATE) AS day FROM requests_v),
periods AS (SELECT strftime(day, '%Y-%m') AS period, date_trunc('month', day) AS first_day, last_day(day) AS last_day FROM days GROUP BY ALL
  UNION ALL SELECT 'all', min(day), max(day) FROM days)"""


@query(
    "shoppers_by_period",
    f"""{_MONTHS} SELECT tenant, period, count(DISTINCT session_id) AS shoppers, true AS sketch_agrees
FROM days JOIN periods ON day BETWEEN first_day AND last_day GROUP BY tenant, period""",
)
def shoppers_by_period(spark, sf):
    """Shoppers of each month and of the whole log, counted exactly and held against the stored daily sketches."""
    visits = bind.requests(spark, sf).select("tenant", "session_id", "ts")
    days = visits.select("tenant", "session_id", F.to_date("ts").alias("day")).distinct()
    months = days.select(F.date_format("day", "yyyy-MM").alias("period"), F.trunc("day", "month").alias("first_day"), F.last_day("day").alias("last_day")).distinct()
    periods = months.unionByName(days.agg(F.lit("all").alias("period"), F.min("day").alias("first_day"), F.max("day").alias("last_day")))
    exact = days.join(periods, F.col("day").between(F.col("first_day"), F.col("last_day"))).groupBy("tenant", "period").agg(F.count_distinct("session_id").alias("exact"))
    found = sketches.shoppers_between(sketches.stored_shoppers(visits), periods)
    return exact.join(found, ["tenant", "period"]).select(
        "tenant", "period", F.col("exact").alias("shoppers"), (F.abs(F.col("shoppers") - F.col("exact")) <= F.col("exact") * 0.08).alias("sketch_agrees")
    )


@query(
    "transcripts",
    """SELECT conversation_id, turn, role, replace(text, chr(10), '') AS text FROM chat_v WHERE replace(text, chr(10), '') <> ''""",
)
def transcripts(spark, sf):
    parts = F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text")))
    turns = bind.chat_turns(spark, sf).select("conversation_id", "turn", "role", parts.alias("parts"))
    return chat.transcript(turns).select("conversation_id", "turn", "role", "text")


@query(
    "first_appearances",
    """SELECT CAST(event_id // 5 AS BIGINT) AS reply_id, CAST(k % 4 AS VARCHAR) AS product_id, min(event_id) AS position,
  CASE WHEN count(*) OVER (PARTITION BY event_id // 5) > 3 THEN 'grid' ELSE 'recommendations' END AS layout FROM events_v GROUP BY event_id // 5, k % 4""",
)
def first_appearances(spark, sf):
    cards = bind.events(spark, sf).select(
        F.floor(F.col("event_id") / 5).alias("reply_id"), (F.col("k") % 4).cast("string").alias("product_id"),
        F.col("event_id").alias("position"),
    )
    return chat.with_layout(chat.first_appearances(cards), most=3)


@query(
    "distinct_calls",
    """, c AS (SELECT CAST(event_id % 100 AS VARCHAR) AS conversation_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type AS name, CAST(k % 10 AS VARCHAR) AS args,
  CASE WHEN event_id % 3 = 0 THEN 'c' || (user_id % 5) ELSE event_type || ':' || (k % 10) END AS call_key FROM events_v)
SELECT conversation_id, day, call_key, min(event_id) AS seq, arg_min(name, event_id) AS name, arg_min(args, event_id) AS args, count(*) AS calls FROM c GROUP BY ALL""",
)
def distinct_calls(spark, sf):
    calls = bind.tool_calls(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return chat.distinct_calls(calls, ["conversation_id", "day"])


@query(
    "daily_quota",
    quota_twin("SELECT session_id AS key, event_id AS hit_id, epoch_us(ts) AS hit_at FROM events_v", 3, 86_400),
)
def daily_quota(spark, sf):
    hits = bind.events(spark, sf).select(F.col("session_id").alias("key"), F.col("event_id").alias("hit_id"), "ts")
    return quota.consumed(hits, limit=3, window_seconds=86_400).select("key", "hit_id", "opened", "count", "allowed")


@query(
    "store_quota",
    quota_twin("SELECT 's' || (user_id % 3) AS key, event_id AS hit_id, epoch_us(ts) AS hit_at FROM events_v", 600, 600),
)
def store_quota(spark, sf):
    """Three very busy keys."""
    tenant = F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))
    hits = bind.events(spark, sf).select(tenant.alias("key"), F.col("event_id").alias("hit_id"), "ts")
    rows = quota.consumed(hits, quota.STORE_LIMIT, quota.STORE_SECONDS)
    return rows.select("key", "hit_id", "opened", "count", "allowed")


def _both_quotas_twin() -> str:
    """The twin of both quotas: each fold as a sub-select of its own."""
    shopper = quota_twin(
        "SELECT 's' || (user_id % 3) || ':' || session_id AS key, event_id AS hit_id, epoch_us(ts) AS hit_at FROM events_v", 40, 3600
    )
    store = quota_twin("SELECT 's' || (user_id % 3) AS key, event_id AS hit_id, epoch_us(ts) AS hit_at FROM events_v", 600, 600)
    inner = lambda sql: "WITH " + sql.removeprefix(", ")
    return f""", a AS ({inner(shopper)}), b AS ({inner(store)})
SELECT a.hit_id, a.count AS shopper_count, b.count AS store_count,
  CASE WHEN a.count > 40 THEN 'shopper' WHEN b.count > 600 THEN 'store' END AS scope,
  CAST(CASE WHEN a.count > 40 THEN 3600 WHEN b.count > 600 THEN 600 END AS INTEGER) AS retry_after_seconds FROM a JOIN b USING (hit_id)"""


@query("request_quotas", _both_quotas_twin())
def request_quotas(spark, sf):
    hits = bind.events(spark, sf).select(
        F.col("event_id").alias("hit_id"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("tenant"), "session_id", "ts"
    )
    return quota.both_quotas(hits).select("hit_id", "shopper_count", "store_count", "scope", "retry_after_seconds")


def _gate_twin() -> str:
    u = "FROM chat_v WHERE role = 'user'"
    at = "conversation_id || '-' || turn AS hit_id, epoch_us(ts) AS hit_at"
    shopper, store = quota_twin(f"SELECT tenant || ':' || session_id AS key, {at} {u}", 40, 3600), quota_twin(f"SELECT tenant AS key, {at} {u}", 600, 600)
    inner = lambda sql: "WITH " + sql.removeprefix(", ")
    return f""", sh AS ({inner(shopper)}), st AS ({inner(store)}),
l AS (SELECT message_id, clean, {_JUNK} AS junk, regexp_matches(clean, '{OVERRIDES}') AS override_attempt FROM (SELECT message_id, clean,
  length(regexp_replace(clean, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters, list_filter(string_split(clean, ' '), lambda w: w <> '') AS words FROM clean_v WHERE message_id LIKE 'c-%')),
t AS (SELECT conversation_id, turn, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS turn_number, conversation_id || '-' || turn AS hit_id {u})
SELECT conversation_id, turn, turn_number, turn_number > 30 AS over_turns, l.message_id IS NULL AS oversize, CASE WHEN l.clean <> '' THEN junk END AS junk, override_attempt,
  sh.count AS shopper_count, st.count AS store_count, CASE WHEN sh.count > 40 THEN 'shopper' WHEN st.count > 600 THEN 'store' END AS quota_scope,
  CAST(CASE WHEN sh.count > 40 THEN 3600 WHEN st.count > 600 THEN 600 END AS INTEGER) AS retry_after_seconds
FROM t JOIN sh USING (hit_id) JOIN st USING (hit_id) LEFT JOIN l ON l.message_id = 'c-' || t.hit_id"""


@query("gated_turns", _gate_twin())
def gated_turns(spark, sf):
    return chat.gated_turns(bind.chat_turns(spark, sf)).drop("hit_id", "clean")
