"""Session identity and per-session slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrine.session import checkpointed


def alias_edges(raw: DataFrame) -> DataFrame:
    """Set of (old, new) rewrites with their first time; empty and self rewrites dropped."""
    return (
        raw.filter("old_session_id <> '' and new_session_id <> '' and old_session_id <> new_session_id")
        .groupBy("old_session_id", "new_session_id")
        .agg(F.min("ts").alias("first_ts"))
    )


def canonical_ids(edges: DataFrame) -> DataFrame:
    """(old_session_id, session_id): the end of each rewrite chain.

    Each old id follows its newest rewrite. Pointers double every round, so a chain of n rewrites
    takes log2(n) rounds; every round is checkpointed. Ids in a rewrite cycle get the cycle's
    lowest id.
    """
    step = edges.groupBy("old_session_id").agg(
        F.max_by("new_session_id", F.struct("first_ts", "new_session_id")).alias("to")
    )
    table = checkpointed(step.select("old_session_id", "to", F.col("to").alias("lowest")))
    total, before, done = table.count(), -1, 0
    while True:
        done += 1
        hop = table.select(
            F.col("old_session_id").alias("to"), F.col("to").alias("next"), F.col("lowest").alias("next_lowest")
        )
        table = checkpointed(
            table.join(hop, "to", "left").select(
                "old_session_id",
                F.coalesce("next", "to").alias("to"),
                F.least("lowest", F.coalesce("next_lowest", "lowest")).alias("lowest"),
                F.col("next").isNull().alias("ended"),
            )
        )
        running = table.filter("not ended").count()
        # What still runs after log2(total) rounds runs in a cycle.
        if running == 0 or (running == before and 2**done > 2 * total):
            break
        before = running
    # An id still moving points into a cycle: all its members see the same lowest member.
    cycle = table.filter("not ended").select(F.col("old_session_id").alias("to"), F.col("lowest").alias("of_cycle"))
    return table.join(cycle, "to", "left").select(
        "old_session_id", F.when(F.col("ended"), F.col("to")).otherwise(F.col("of_cycle")).alias("session_id")
    )


def with_canonical(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rewrite ``session_id``; ids without a rewrite stay."""
    return (
        rows.join(canonical.withColumnRenamed("session_id", "_new"), rows.session_id == canonical.old_session_id, "left")
        .withColumn("session_id", F.coalesce("_new", "session_id"))
        .drop("_new", "old_session_id")
    )


def of_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    return rows.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
