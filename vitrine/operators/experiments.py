"""A/B experiments and merchandising rules replayed over request logs.

Definitions live as one list per tenant, so requests meet them by an equality join on the tenant
and are matched inside the row. Requests that cannot differ (same tenant, query and quarter hour)
are reduced to one context before matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine import schemas
from vitrine.functions import matching, predicates, text

DEFAULT_ASSOCIATION_LIMIT = 5


def parse_definitions(rows: DataFrame, column: str, schema) -> DataFrame:
    """JSON definition list (one per tenant) to an array column of the same name."""
    return rows.withColumn(column, F.from_json(column, schema))


def read_experiments(rows: DataFrame) -> DataFrame:
    return parse_definitions(rows, "experiments", schemas.EXPERIMENTS)


def read_rules(rows: DataFrame) -> DataFrame:
    return parse_definitions(rows, "rules", schemas.RULES)


def contexts(requests: DataFrame, *keys: str) -> DataFrame:
    """Requests reduced to what targeting looks at. Zone offsets are multiples of 15 minutes."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 900) * 900)
    return requests.groupBy("tenant", *keys, text.js_trim(F.lower("query")).alias("query"), slot.alias("slot")).agg(
        F.count("*").alias("requests"), F.min("ts").alias("first_ts")
    )


def targeted(definition: Column, query: Column, ts: Column) -> Column:
    window = definition["timeWindow"]
    matches = predicates.query_matches(
        definition["mode"], definition["patterns"], definition["matchType"], query
    ) & predicates.hour_matches(ts, window["timezone"], window["startHour"], window["endHour"])
    return definition.isNull() | matches


def matched(context_rows: DataFrame, definitions: DataFrame, column: str, condition: str) -> DataFrame:
    """One row per context and matching definition, with its place in the list."""
    listed = F.transform(column, lambda d, i: F.struct(i.alias("place"), d.alias("definition")))
    joined = context_rows.join(definitions, "tenant").withColumn("_all", listed)
    passing = F.filter("_all", lambda x: targeted(x["definition"][condition], F.col("query"), F.col("slot")))
    return joined.select(*context_rows.columns, F.inline(passing))


def arm_bounds(experiments: DataFrame) -> DataFrame:
    """[lo, hi) bucket range per arm: running weight share of the enrolled range.

    The last arm takes what rounding leaves. Lists with no weight have no arms.
    """
    arms = experiments.select(
        "tenant", F.explode("experiments").alias("e")
    ).select(
        "tenant", F.col("e.id").alias("experiment_id"),
        F.floor(F.col("e.trafficPct") * 100).alias("enrolled"),
        F.posexplode("e.arms").alias("arm_place", "arm"),
    )
    per = Window.partitionBy("tenant", "experiment_id")
    running = per.orderBy("arm_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("arm.weight")
    return (
        arms.withColumn("total", F.sum(weight).over(per))
        .withColumn("share_hi", F.sum(weight / F.col("total") * F.col("enrolled")).over(running))
        .withColumn("last", F.max("arm_place").over(per) == F.col("arm_place"))
        .filter("total > 0")
        .withColumn("hi", F.when(F.col("last"), F.col("enrolled").cast("double")).otherwise(F.col("share_hi")))
        .withColumn("lo", F.coalesce(F.lag("share_hi").over(per.orderBy("arm_place")), F.lit(0.0)))
        .select("tenant", "experiment_id", "enrolled", "arm_place", F.col("arm.key").alias("arm"), F.col("arm.patch").alias("patch"), "lo", "hi")
    )


def buckets(pairs: DataFrame) -> DataFrame:
    """Traffic bucket per different (experiment, session); no session, no bucket."""
    return (
        pairs.filter("session_id is not null and session_id <> ''")
        .select("tenant", "experiment_id", "session_id")
        .distinct()
        .withColumn("bucket", matching.traffic_bucket(F.col("experiment_id"), F.col("session_id")))
    )


def assigned(bucketed: DataFrame, bounds: DataFrame) -> DataFrame:
    """Arm per (experiment, session): the bound range the bucket falls into."""
    return bucketed.join(bounds, ["tenant", "experiment_id"]).filter(
        (F.col("bucket") < F.col("enrolled")) & (F.col("bucket") >= F.col("lo")) & (F.col("bucket") < F.col("hi"))
    )


def exposures(requests: DataFrame, experiments: DataFrame) -> DataFrame:
    """First exposure per (experiment, session): arm, query and time."""
    hits = matched(contexts(requests, "session_id"), experiments, "experiments", "targeting").select(
        "tenant", "session_id", "query", "first_ts", "requests", "place", F.col("definition.id").alias("experiment_id")
    )
    first = hits.groupBy("tenant", "experiment_id", "session_id").agg(
        F.min(F.struct("first_ts", "query")).alias("first"),
        F.sum("requests").alias("requests"),
        F.min("place").alias("place"),
    )
    arms = assigned(buckets(first), arm_bounds(experiments))
    return arms.join(first, ["tenant", "experiment_id", "session_id"]).select(
        "tenant", "experiment_id", "session_id", "arm", "bucket", "patch", "place", "requests",
        F.col("first.first_ts").alias("first_ts"), F.col("first.query").alias("query"),
    )


def exposed(requests: DataFrame, experiments: DataFrame) -> DataFrame:
    """Every context of a session with the arms it was served: (tenant, query, session_id, slot, label, place, patch)."""
    hits = matched(contexts(requests, "session_id"), experiments, "experiments", "targeting").select(
        "tenant", "session_id", "query", "slot", "place", F.col("definition.id").alias("experiment_id")
    )
    arms = assigned(buckets(hits), arm_bounds(experiments)).select("tenant", "experiment_id", "session_id", "arm", "patch")
    return hits.join(arms, ["tenant", "experiment_id", "session_id"]).select(
        "tenant", "query", "session_id", "slot", F.concat_ws(":", "experiment_id", "arm").alias("label"), "place", "patch"
    )


def rule_hits(requests: DataFrame, rules: DataFrame) -> DataFrame:
    return matched(contexts(requests), rules, "rules", "condition").select(
        "tenant", "query", "slot", "requests", "place",
        F.col("definition.id").alias("rule_id"), F.col("definition.patch").alias("patch"),
    )


def daily_counts(hits: DataFrame) -> DataFrame:
    """Matches per rule and UTC day."""
    return hits.groupBy("tenant", "rule_id", F.to_date("slot").alias("day")).agg(F.sum("requests").alias("matches"))


def effective_boosts(hits: DataFrame, field: str, *keys: str) -> DataFrame:
    """Boost per key after all matched patches; the later definition wins."""
    return hits.select(*keys, "place", F.explode(f"patch.{field}").alias("key", "value")).groupBy(*keys, "key").agg(
        F.max_by("value", "place").alias("value")
    )


def effective_multiplier(hits: DataFrame, *keys: str) -> DataFrame:
    """Product of all matched profile multipliers."""
    return hits.filter("patch.profileBoostMultiplier is not null").groupBy(*keys).agg(
        F.product("patch.profileBoostMultiplier").alias("multiplier")
    )


def boosted(
    rows: DataFrame, boosts: DataFrame, soft_boosts: DataFrame, multipliers: DataFrame, keys: list[str] = ["tenant", "query"], row_keys: list[str] = []
) -> DataFrame:
    """Base score times the profile multiplier plus product and soft-category boosts.

    ``rows(*keys, *row_keys, id, soft_category, rrf)``; the settings are keyed by ``keys``, and ``row_keys`` tell
    result lists of one setting apart.
    """
    per_product = boosts.select(*keys, F.col("key").alias("id"), F.col("value").alias("product_boost"))
    result = [*keys, *row_keys, "id"]
    soft = (
        rows.select(*result, F.explode("soft_category").alias("key"))
        .join(soft_boosts, [*keys, "key"])
        .groupBy(*result)
        .agg(F.sum("value").alias("soft_boost"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        rows.join(multipliers, keys, "left")
        .join(per_product, [*keys, "id"], "left")
        .join(soft, result, "left")
        .withColumn(
            "boosted_score",
            F.col("rrf") * F.coalesce("multiplier", F.lit(1.0)) + zero(F.col("product_boost")) + zero(F.col("soft_boost")),
        )
    )


def association_pins(associations: DataFrame, products: DataFrame) -> DataFrame:
    """Products of associated categories per query, highest boost first.

    ``associations(tenant, query, categories, soft_categories, limit)``. Every taxonomy value keeps as
    many of its best products as the largest limit that asks for it, which is enough for the best of any union of values.
    """
    visible = products.filter(predicates.visible(F.col("hidden")))
    values = visible.select(
        "tenant", "id", "boost",
        F.explode(
            F.concat(
                F.transform("category", lambda v: F.struct(F.lit("category").alias("kind"), v.alias("value"))),
                F.transform("soft_category", lambda v: F.struct(F.lit("soft").alias("kind"), v.alias("value"))),
            )
        ).alias("t"),
    ).select("tenant", "id", "boost", "t.*")
    none = F.array().cast("array<string>")
    wanted = associations.withColumn(
        "limit", F.when(F.coalesce("limit", F.lit(0)) == 0, DEFAULT_ASSOCIATION_LIMIT).otherwise(F.col("limit"))
    ).select(
        "tenant", "query", "limit",
        F.explode(
            F.concat(
                F.transform(F.coalesce("categories", none), lambda v: F.struct(F.lit("category").alias("kind"), v.alias("value"))),
                F.transform(F.coalesce("soft_categories", none), lambda v: F.struct(F.lit("soft").alias("kind"), v.alias("value"))),
            )
        ).alias("t"),
    ).select("tenant", "query", "limit", "t.*")
    most = wanted.groupBy("tenant", "kind", "value").agg(F.max("limit").alias("most"))
    shelf = Window.partitionBy("tenant", "kind", "value").orderBy(F.desc_nulls_last("boost"), "id")
    best = values.join(most, ["tenant", "kind", "value"]).withColumn("n", F.row_number().over(shelf)).filter(F.col("n") <= F.col("most")).drop("n", "most")
    found = wanted.join(best, ["tenant", "kind", "value"]).select("tenant", "query", "limit", "id", "boost").distinct()
    w = Window.partitionBy("tenant", "query").orderBy(F.desc_nulls_last("boost"), "id")
    return found.withColumn("pin_position", F.row_number().over(w)).filter(F.col("pin_position") <= F.col("limit")).drop("limit")


def pins_after_override(existing: DataFrame, patch: DataFrame) -> DataFrame:
    """Patch pins, then the existing pins whose query (any case) the patch does not name."""
    named = patch.select("tenant", F.lower(F.coalesce("query", F.lit(""))).alias("_q")).distinct()
    kept = existing.withColumn("_q", F.lower(F.coalesce("query", F.lit("")))).join(named, ["tenant", "_q"], "left_anti").drop("_q")
    return patch.withColumn("origin", F.lit("patch")).unionByName(kept.withColumn("origin", F.lit("existing")))
