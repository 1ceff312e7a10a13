"""Request quotas whose window opens at a key's first hit and lasts a fixed time.

Windows follow from the data: the next one opens at the first hit at or after the end of the
current one. Only the window openings are sequential, so they are found first; hits are then
matched to openings and numbered in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.operators.running import as_of, with_running
from vitrine.session import checkpointed

# --- Fixed values -------------------------------------------------------------------------------
SHOPPER_LIMIT, SHOPPER_SECONDS = 40, 3600
STORE_LIMIT, STORE_SECONDS = 600, 600
# -------------------------------------------------------------------------------------------------


#: Doublings of a round, which ends with written tables.
DOUBLINGS = 3
KEY = ["key", "window_us"]


def _chunk(at: Column) -> Column:
    """Four windows of a key's time line."""
    return F.floor(at / (4 * F.col("window_us")))


def _with_previous(times: DataFrame) -> DataFrame:
    """Different ``times(key, window_us, at)`` with the time before of their key, ``last_at``: each is read and sorted once in its chunk."""
    chunked = times.withColumn("_chunk", _chunk(F.col("at")))
    ends = chunked.groupBy(*KEY, "_chunk").agg(F.max("at").alias("_end"))
    carried = ends.select(*KEY, "_chunk", F.lag("_end").over(Window.partitionBy(*KEY).orderBy("_chunk")).alias("_before"))
    local = chunked.withColumn("_last", F.lag("at").over(Window.partitionBy(*KEY, "_chunk").orderBy("at")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*KEY, "_chunk"]]
    return local.alias("l").join(carried.alias("c"), same).select(*[F.col(f"l.{c}") for c in times.columns], F.coalesce("_last", "_before").alias("last_at"))


def openings(hits: DataFrame) -> DataFrame:
    """(key, window_us, opened) in epoch microseconds for ``hits(key, window_us, at)``.

    A hit with no other hit of its key less than a window before it always opens a window, so a key's
    times fall into runs that do not depend on each other. Inside a run each time points to the first
    one a window later, and the chain of openings is marked by pointer doubling: the longest run of n
    windows takes log2(n) joins on (key, time), whatever the number of hits of a key. Several doublings are
    one job, and quotas of different windows go through the same ones.
    """
    times = checkpointed(hits.select(*KEY, "at").distinct())
    # written: both sides of the as-of join below read it
    earlier = checkpointed(_with_previous(times))
    opens_run = F.col("last_at").isNull() | (F.col("at") - F.col("last_at") >= F.col("window_us"))
    # As-of looks back, so the next hit a window later is looked for on the negated time line.
    mirrored = earlier.select(*KEY, "at", opens_run.alias("opens_run"), (-F.col("at")).alias("from"))
    pointers = checkpointed(
        as_of(
            mirrored.withColumn("until", F.col("from") - F.col("window_us")),
            mirrored.select(*KEY, "from", F.col("at").alias("to"), F.col("opens_run").alias("to_opens_run")),
            KEY, "until", "from", "from", ["to", "to_opens_run"], chunk=_chunk,
        ).select(*KEY, "at", "opens_run", "to", "to_opens_run")
    )
    marked = pointers.filter("opens_run").select(*KEY, "at")
    # Pointers into the start of a run lead to what is marked already.
    jump = pointers.filter("to is not null and not to_opens_run").select(*KEY, "at", "to")
    while not jump.isEmpty():
        for _ in range(DOUBLINGS):
            marked = marked.unionByName(marked.join(jump, [*KEY, "at"]).select(*KEY, F.col("to").alias("at")))
            onward = jump.select(*KEY, F.col("at").alias("to"), F.col("to").alias("far"))
            jump = jump.join(onward, [*KEY, "to"]).select(*KEY, "at", F.col("far").alias("to"))
        marked, jump = checkpointed(marked.distinct()), checkpointed(jump)
    return marked.select(*KEY, F.col("at").alias("opened"))


def counted(hits: DataFrame) -> DataFrame:
    """Each of ``hits(key, window_us, ts, hit_id)`` with the opening of its window and its number there.

    Every hit counts, denied ones too. Hits are numbered inside chunks of a 64th of a window, so the window of a
    busy store is no single task.
    """
    timed = hits.withColumn("at", F.unix_micros("ts"))
    placed = as_of(timed, openings(timed), KEY, "at", "opened", "opened", ["opened"], chunk=_chunk).drop("matched_opened")
    part = F.floor((F.col("at") - F.col("opened")) * 64 / F.col("window_us"))
    numbered = with_running(placed, [*KEY, "opened"], part, ["at", "hit_id"], sums={"count": F.lit(1)})
    return numbered.withColumn("count", F.col("count").cast("long")).drop("at")


def consumed(hits: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Each of ``hits(key, ts, hit_id)`` with its number in its window and whether it was allowed."""
    rows = counted(hits.withColumn("window_us", F.lit(window_seconds * 1_000_000).cast("long")))
    return rows.drop("window_us").withColumn("allowed", F.col("count") <= limit)


def both_quotas(hits: DataFrame) -> DataFrame:
    """Shopper and store quota of each hit (both always consumed) and the scope of a denial.

    ``hits(hit_id, tenant, session_id, ts)``. Both are counted in one pass over the hits' two keys.
    """
    quota = lambda of, seconds, *parts: F.struct(
        F.lit(of).alias("of"), F.concat_ws(":", F.lit(of), *parts).alias("key"), F.lit(seconds * 1_000_000).cast("long").alias("window_us")
    )
    quotas = F.array(quota("shopper", SHOPPER_SECONDS, "tenant", "session_id"), quota("store", STORE_SECONDS, "tenant"))
    rows = counted(hits.select("hit_id", "ts", F.inline(quotas)))
    counts = rows.groupBy("hit_id").agg(
        F.max(F.when(F.col("of") == "shopper", F.col("count"))).alias("shopper_count"), F.max(F.when(F.col("of") == "store", F.col("count"))).alias("store_count")
    )
    scope = F.when(F.col("shopper_count") > SHOPPER_LIMIT, "shopper").when(F.col("store_count") > STORE_LIMIT, "store")
    wait = F.when(F.col("scope") == "shopper", SHOPPER_SECONDS).when(F.col("scope") == "store", STORE_SECONDS)
    return hits.join(counts, "hit_id").withColumn("scope", scope).withColumn("retry_after_seconds", wait)
