"""Stored sketches: distinct shoppers of any period, and facets whose rare values are never shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vitrine.functions import predicates
from vitrine.session import checkpointed, run_folder

#: 2^LOG entries of a shopper sketch: counts below that are exact, larger ones within 1.6 % (one standard error).
LOG_ENTRIES = 12
#: Values that a facet's sketch can track; those above N / TRACKED_SHARE of N rows are never missed.
TRACKED = 8192
TRACKED_SHARE = TRACKED * 3 // 4


def stored_shoppers(visits: DataFrame, folder: str | None = None) -> DataFrame:
    """``(tenant, day, sketch)`` of ``visits(tenant, session_id, ts)``, by day; blank sessions do not count.

    A later day is one more partition; days already stored are not read for it.
    """
    folder = folder or run_folder(visits.sparkSession, "shopper-sketches")
    session = F.nullif("session_id", F.lit(""))
    daily = visits.groupBy("tenant", F.to_date("ts").alias("day")).agg(F.theta_sketch_agg(session, LOG_ENTRIES).alias("sketch"))
    daily.write.mode("append").partitionBy("day").parquet(folder)
    return visits.sparkSession.read.schema("tenant string, sketch binary, day date").parquet(folder)


def shoppers_between(sketches: DataFrame, periods: DataFrame) -> DataFrame:
    """``(tenant, period, shoppers)`` for ``periods(period, first_day, last_day)``, from stored sketches alone."""
    held = sketches.join(periods, F.col("day").between(F.col("first_day"), F.col("last_day")))
    return held.groupBy("tenant", "period").agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", LOG_ENTRIES)).alias("shoppers"))


def facet(products: DataFrame, field: str, limit: int, strict: bool = True, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``catalog.facet``: candidates from a frequent-item sketch, then exact counts of these alone.

    A sketch of a tenant's N values holds every value that occurs more than N / (3/4 tracked) times. Where the
    last place's exact count is not above that, or the sketch may have dropped values, the tenant is counted in full.
    """
    rows = products.filter(predicates.visible(F.col("hidden")))
    if strict:
        rows = rows.filter(predicates.strict_stock(F.col("stock_status_canonical")))
    values = rows.select("tenant", F.explode(field).alias("value"))
    sketched = values.groupBy("tenant").agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_accumulate(value, {tracked}), {min(tracked // 4, 10 * limit)})").alias("top"), F.count("*").alias("n")
    )
    sketched = checkpointed(sketched)  # a bounded list per tenant
    named = sketched.select("tenant", F.explode("top").alias("x")).select("tenant", F.col("x.item").alias("value"))
    # a value a task at most once per candidate is shuffled
    exact = values.join(named, ["tenant", "value"], "left_semi").groupBy("tenant", "value").agg(F.count("*").alias("products"))
    by_count = Window.partitionBy("tenant").orderBy(F.desc("products"), "value")
    first = checkpointed(exact.withColumn("position", F.row_number().over(by_count)).filter(F.col("position") <= limit))
    last = first.groupBy("tenant").agg(F.min("products").alias("least"), F.count("*").alias("found"))
    sure = sketched.join(last, "tenant", "left").select(
        "tenant",
        # all candidates listed and fewer than asked for: nothing was dropped; else the last place must be above the sketch's error
        F.when(F.coalesce(F.size("top"), F.lit(0)) < min(tracked // 4, 10 * limit), F.col("n") <= F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x["count"]))
        .otherwise((F.col("found") >= limit) & (F.col("least") > F.col("n") / F.lit(tracked * 3 // 4))).alias("sure"),
    )
    unsure = sure.filter(~F.coalesce("sure", F.lit(False))).select("tenant")
    plain = values.join(unsure, "tenant", "left_semi").groupBy("tenant", "value").agg(F.count("*").alias("products"))
    plain = plain.withColumn("position", F.row_number().over(by_count)).filter(F.col("position") <= limit)
    return first.join(unsure, "tenant", "left_anti").unionByName(plain).filter("value is not null and value <> ''")
