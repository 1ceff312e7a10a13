"""Chat logs: message audit, turns, token cost, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import predicates, text
from vitrine.operators import quota
from vitrine.operators.running import with_running

# --- Fixed values -------------------------------------------------------------------------------
MAX_TURNS = 30
REJECT_CHARS = 4 * text.MESSAGE_CHARS
RATES = {"input": 1.5, "output": 7.5, "cache_write": 1.5, "cache_read": 0.15}  # USD per million tokens
FEEDBACK_EVENTS = ["opened", "dismissed", "closed", "product_click", "add_to_cart", "helpful", "not_helpful"]
EXPORT_CHARS = 24_000
EXPORT_MARKER = "\n…[truncated — narrow the filters or lower the limit]"
TURN_CHUNK = 256
# -------------------------------------------------------------------------------------------------


def oversize(messages: DataFrame) -> DataFrame:
    return messages.filter(text.utf16_length(F.col("text")) > REJECT_CHARS)


def audited(messages: DataFrame) -> DataFrame:
    """Clean text, junk class with its canned reply, override flag; oversize messages are out."""
    rows = messages.filter(text.utf16_length(F.col("text")) <= REJECT_CHARS)
    rows = rows.withColumn("clean", text.sanitize(F.col("text")))
    junk = F.when(F.col("clean") != "", text.junk_class(F.col("clean")))
    return (
        rows.withColumn("junk", junk)
        .withColumn("reply", text.lookup(text.JUNK_REPLIES, F.col("junk")))
        .withColumn("override_attempt", text.override_attempt(F.col("clean")))
    )


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Shopper turns numbered per conversation; those past the cap are marked rejected."""
    numbered = with_running(
        turns.filter("role = 'user'"), ["conversation_id"], F.floor(F.col("turn") / TURN_CHUNK), ["turn"],
        sums={"turn_number": F.lit(1).cast("long")},
    )
    return numbered.withColumn("rejected", F.col("turn_number") > MAX_TURNS)


def gated_turns(turns: DataFrame) -> DataFrame:
    """Every shopper turn with all that is tested before the model is asked.

    ``turns(conversation_id, tenant, session_id, turn, ts, role, text)``: length, junk class and override flag of the
    text, the turn cap of the conversation, and the quotas of shopper and store (a turn consumes both whatever its text).
    """
    asked = numbered_turns(turns).withColumn("hit_id", F.concat_ws("-", "conversation_id", "turn"))
    kept = audited(asked).select("hit_id", "clean", "junk", "override_attempt")
    counted = quota.both_quotas(asked.select("hit_id", "tenant", "session_id", "ts")).select(
        "hit_id", "shopper_count", "store_count", F.col("scope").alias("quota_scope"), "retry_after_seconds"
    )
    return (
        asked.select("hit_id", "conversation_id", "turn", "turn_number", F.col("rejected").alias("over_turns"))
        .join(counted, "hit_id").join(kept, "hit_id", "left")
        .withColumn("oversize", F.col("clean").isNull())
    )


def guarded_turns(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A turn keeps its stored conversation only if tenant and provider agree, else starts anew."""
    stored = conversations.select(
        "conversation_id", F.col("tenant").alias("stored_tenant"), F.col("provider").alias("stored_provider")
    )
    same = (F.col("stored_tenant") == F.col("tenant")) & (F.col("stored_provider") == F.col("provider"))
    return turns.join(stored, "conversation_id", "left").withColumn("is_new", ~F.coalesce(same, F.lit(False)))


def turn_usage(rounds: DataFrame) -> DataFrame:
    """Token usage per turn, cached prompt tokens counted apart."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return rounds.groupBy("conversation_id", "tenant", "session_id", "turn").agg(
        F.count("*").alias("rounds"),
        F.sum(F.greatest(F.lit(0), n("prompt_tokens") - n("cached_tokens"))).alias("input_tokens"),
        F.sum(n("visible_tokens") + n("thinking_tokens")).alias("output_tokens"),
        F.sum(n("cached_tokens")).alias("cache_read_tokens"),
    )


def cost(usage: DataFrame, rates: dict[str, float] | None = None) -> Column:
    r = RATES | (rates or {})
    written = F.col("cache_write_tokens") if "cache_write_tokens" in usage.columns else F.lit(0)
    return (
        F.col("input_tokens") * r["input"]
        + F.col("output_tokens") * r["output"]
        + F.col("cache_read_tokens") * r["cache_read"]
        + written * r["cache_write"]
    ) / 1_000_000


def turn_costs(usage: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    return usage.withColumn("cost_usd", F.round(cost(usage, rates), 8))


def running_costs(usage: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Cumulative tokens and cost per conversation in turn order."""
    rows = with_running(
        usage.withColumn("_cost", cost(usage, rates)),
        ["conversation_id"], F.floor(F.col("turn") / TURN_CHUNK), ["turn"],
        sums={
            "total_input": F.col("input_tokens"),
            "total_output": F.col("output_tokens"),
            "total_cost_usd": F.col("_cost"),
        },
    )
    return rows.drop("_cost").withColumn("total_cost_usd", F.round("total_cost_usd", 8))


def latest_conversations(writes: DataFrame) -> DataFrame:
    """One row per conversation: first write time kept, every other field from the last write."""
    fields = [c for c in writes.columns if c not in ("conversation_id", "written_at")]
    order = F.struct("written_at", "turns")
    return (
        writes.groupBy("conversation_id")
        .agg(
            F.min("written_at").alias("created_at"),
            F.max("written_at").alias("updated_at"),
            F.max_by(F.struct(*fields), order).alias("last"),
        )
        .select("conversation_id", "created_at", "updated_at", "last.*")
    )


def accepted_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.filter(F.col("event").isin(*FEEDBACK_EVENTS))


def engagement(feedback: DataFrame) -> DataFrame:
    """Product clicks and cart additions per conversation, from the flat feedback log."""
    return accepted_feedback(feedback).groupBy("conversation_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event") == "product_click").alias("product_clicks"),
        F.count_if(F.col("event") == "add_to_cart").alias("add_to_carts"),
        F.min("at").alias("first_at"),
    )


def upserted_with_feedback(conversations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Conversations with their engagement; feedback on an unknown id creates the row."""
    joined = conversations.join(engagement(feedback), "conversation_id", "full_outer")
    return (
        joined.withColumn("created_at", F.coalesce("created_at", "first_at"))
        .drop("first_at")
        .na.fill(0, ["events", "product_clicks", "add_to_carts"])
    )


def conversation_stats(conversations: DataFrame, usage: DataFrame) -> DataFrame:
    """Conversations with their summed usage and cost."""
    per = turn_costs(usage).groupBy("conversation_id").agg(
        F.sum("cost_usd").alias("estimated_cost_usd"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
    )
    return conversations.join(per, "conversation_id", "left")


def by_reason(conversations: DataFrame, as_of_ts: Column, days: int = 30) -> DataFrame:
    """Conversations, turns and cost per trigger reason; no reason is a group of its own."""
    recent = conversations.filter(predicates.recent(F.col("created_at"), as_of_ts, days))
    return recent.groupBy("tenant", "reason").agg(
        F.count("*").alias("conversations"),
        F.sum("turns").alias("turns"),
        F.round(F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))), 6).alias("estimated_cost_usd"),
    )


def totals(conversations: DataFrame, as_of_ts: Column, days: int = 30) -> DataFrame:
    recent = conversations.filter(predicates.recent(F.col("created_at"), as_of_ts, days))
    z = lambda c: F.coalesce(c, F.lit(0))
    return recent.groupBy("tenant").agg(
        F.count("*").alias("conversations"),
        F.sum("turns").alias("turns"),
        F.round(F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))), 6).alias("estimated_cost_usd"),
        F.sum(z("input_tokens")).alias("input_tokens"),
        F.sum(z("output_tokens")).alias("output_tokens"),
        F.sum(z("cache_read_tokens")).alias("cache_read_tokens"),
    )


def distinct_shoppers(conversations: DataFrame, approximate: bool = False) -> DataFrame:
    session = F.nullif("session_id", F.lit(""))
    count = F.approx_count_distinct(session) if approximate else F.count_distinct(session)
    return conversations.groupBy("tenant").agg(count.alias("unique_shoppers"))


def transcript(turns: DataFrame) -> DataFrame:
    """Text of each turn from its parts; turns without text are dropped.

    ``turns(conversation_id, turn, role, parts)``, parts being an array of structs with ``text``.
    """
    words = F.filter("parts", lambda p: p["text"].isNotNull())
    joined = F.array_join(F.transform(words, lambda p: p["text"]), "")
    return turns.withColumn("text", joined).filter("text <> ''")


def first_appearances(cards: DataFrame) -> DataFrame:
    """First place of each product in each reply."""
    return cards.groupBy("reply_id", "product_id").agg(F.min("position").alias("position"))


def distinct_calls(calls: DataFrame, scope: list[str]) -> DataFrame:
    """First call per call id within a scope, or per name and arguments when there is no id."""
    key = F.coalesce("call_id", F.concat_ws(":", "name", "args"))
    return (
        calls.groupBy(*scope, key.alias("call_key"))
        .agg(F.min_by(F.struct("seq", "name", "args"), "seq").alias("first"), F.count("*").alias("calls"))
        .select(*scope, "call_key", "first.*", "calls")
    )


def exported(rows: DataFrame, *columns: str, max_chars: int = EXPORT_CHARS) -> DataFrame:
    """Rows as JSON text, cut with a marker."""
    body = F.to_json(F.struct(*columns))
    cut = F.when(
        text.utf16_length(body) > max_chars, F.concat(text.utf16_left(body, max_chars), F.lit(EXPORT_MARKER))
    ).otherwise(body)
    return rows.withColumn("body", cut)


def with_layout(cards: DataFrame, most: int = 5) -> DataFrame:
    """More than five different cards in a reply are laid out as a grid."""
    counts = cards.groupBy("reply_id").agg(F.count("*").alias("_cards"))
    layout = F.when(F.col("_cards") > most, "grid").otherwise("recommendations")
    return cards.join(counts, "reply_id").withColumn("layout", layout).drop("_cards")
