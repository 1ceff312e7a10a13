"""Running totals and as-of values that stay parallel inside one hot key.

A plain window puts all rows of a key into one task. Here every key is cut into chunks of its order
column (an hour, a day, a run of turn numbers); rows only meet inside their chunk, chunk totals are
aggregated with map-side combining, and what came before a chunk is carried in from those totals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.session import checkpointed


def with_running(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Add running columns over ``keys`` in ``order`` (a total order that refines ``chunk``).

    ``sums`` maps an output name to the value added per row (inclusive of the row). ``lasts`` maps
    an output name to ``(is_present, value)``: the value of the latest row, up to and including this
    one, for which ``is_present`` holds.
    """
    sums, lasts = sums or {}, lasts or {}
    base = df.withColumn("_chunk", chunk)
    position = F.struct(*order)
    totals = base.groupBy(*keys, "_chunk").agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()],
        *[
            F.max_by(F.when(present, F.struct(value.alias("v"))), F.when(present, position)).alias(f"_last_{name}")
            for name, (present, value) in lasts.items()
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}") for n in sums],
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_last_{n}") for n in lasts],
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = base.select(
        "*",
        *[F.sum(value).over(within).alias(f"_in_{n}") for n, value in sums.items()],
        *[
            F.last(F.when(present, F.struct(value.alias("v"))), ignorenulls=True).over(within).alias(f"_at_{n}")
            for n, (present, value) in lasts.items()
        ],
    )
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_chunk"]]
    joined = local.alias("l").join(carried.alias("c"), same, "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.col(f"_sum_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_at_{n}"), F.col(f"_last_{n}"))["v"].alias(n) for n in lasts],
    )


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, total: str | None = None) -> DataFrame:
    """Add the 1-based place ``name`` of each row in its key's order, and the key's number of rows.

    Rows are dealt in ranges of (keys, order), numbered inside a range and continued from the running counts
    of the ranges, so a key of a third of all rows is as many tasks as it fills. ``order`` must be total.
    """
    # written once: numbers must not change if a range is read again
    ranged = checkpointed(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*keys, "_range", (before - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(key).alias("_total"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_range"]]
    joined = ranged.alias("r").join(shifts.alias("s"), same)
    sized = [F.col("_total").alias(total)] if total else []
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_at") + F.col("_shift")).alias(name), *sized)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    right_id: str,
    values: list[str],
    chunk: Callable[[Column], Column] = lambda ts: F.date_trunc("day", ts),
) -> DataFrame:
    """Each left row with the latest right row of its keys at or before it (linear, no pair join).

    Equal timestamps count as before; among equal right timestamps the highest ``right_id`` wins.
    Adds ``values`` from the right side and ``matched_<right_ts>``.
    """
    payload = F.struct(*values, F.col(right_ts).alias(f"matched_{right_ts}"))
    side_l = left.select(
        *keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_id].dataType).alias("_id"),
        F.struct(*left.columns).alias("_row"), F.lit(None).alias("_payload"),
    )
    side_r = right.select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(right_id).alias("_id"),
        F.lit(None).alias("_row"), payload.alias("_payload"),
    )
    row_type, payload_type = side_l.schema["_row"].dataType, side_r.schema["_payload"].dataType
    both = side_l.withColumn("_payload", F.lit(None).cast(payload_type)).unionByName(
        side_r.withColumn("_row", F.lit(None).cast(row_type))
    )
    out = with_running(
        both,
        keys,
        chunk(F.col("_ts")),
        ["_ts", "_side", "_id"],
        lasts={"_match": (F.col("_side") == 0, F.col("_payload"))},
    )
    return out.filter("_side = 1").select("_row.*", "_match.*")
