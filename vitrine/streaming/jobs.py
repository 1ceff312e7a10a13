"""Structured Streaming forms of the log operators.

Each function takes a streaming DataFrame with event time and returns one, to be written by the
caller. ``to_table`` writes to the shared folder, idempotently per batch.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from vitrine.functions import matching, text
from vitrine.operators import chat, experiments
from vitrine.session import run_folder

BUCKETS = 64
# The state store that keeps state on disk; custom state needs it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table, one file or a folder of them, as a file stream; the schema comes from the files, never from inference."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, as a stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


@contextmanager
def _setting(spark, name: str, value: str | None):
    """A session setting for as long as it takes to start a stream, which keeps its own copy."""
    before = spark.conf.get(name, None)
    if value is not None:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def to_table(
    stream: DataFrame, name: str, mode: str = "append", folder: str | None = None, state_store: str | None = None
) -> DataFrame:
    """Drain a stream into a parquet folder and return it as a table with its batch number.

    A batch overwrites only its own sub-folder, so a replayed batch leaves no double rows.
    """
    spark = stream.sparkSession
    folder = folder or run_folder(spark, name)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch_number={number}")

    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
    )
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", state_store):
        query = writer.start()
    query.awaitTermination()
    wide = T.StructType([*schema.fields, T.StructField("batch_number", T.IntegerType())])
    return spark.read.schema(wide).parquet(f"{folder}/data")


def last_batch(table: DataFrame) -> DataFrame:
    """The rows of the newest batch of a complete-mode table."""
    newest = table.agg(F.max("batch_number").alias("batch_number"))
    return table.join(newest, "batch_number", "left_semi").drop("batch_number")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode table."""
    others = [c for c in table.columns if c not in (*keys, "batch_number")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_number").alias("last")).select(*keys, "last.*")


def deduplicated_orders(orders: DataFrame, delay: str = "2 hours") -> DataFrame:
    """First delivery per order id; a redelivery within the delay is dropped."""
    return orders.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["order_id"])


def daily_rule_counts(hits: DataFrame, delay: str = "1 day") -> DataFrame:
    """Matches per rule and UTC day, updated as they arrive."""
    return (
        hits.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "rule_id")
        .agg(F.count("*").alias("matches"))
        .select(F.col("window.start").alias("day"), "rule_id", "matches")
    )


def conversation_sessions(turns: DataFrame, gap: str = "3 hours", delay: str = "3 hours") -> DataFrame:
    """Conversation histories: each lives three hours past its last write."""
    return (
        turns.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), "conversation_id")
        .agg(F.count("*").alias("turns"))
        .select("conversation_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "turns")
    )


def matched_triggers(triggers: DataFrame, turns: DataFrame, minutes: int = 30, delay: str = "1 hour") -> DataFrame:
    """Turns joined to the triggers parked for their conversation at most 30 minutes before."""
    left = turns.withWatermark("ts", delay).alias("t")
    right = triggers.withWatermark("parked_at", delay).alias("p")
    return left.join(
        right,
        F.expr(
            "t.conversation_id = p.conversation_id and t.ts >= p.parked_at "
            f"and t.ts <= p.parked_at + interval {minutes} minutes"
        ),
        "leftOuter",
    ).select("t.conversation_id", "t.turn", "t.ts", "p.parked_at", "p.trigger_reason")


def enriched_orders(orders: DataFrame, clicks: DataFrame, days: int) -> DataFrame:
    """Orders joined to clicks of the same session and product in the days before."""
    left = orders.withWatermark("created_at", "1 day").alias("o")
    right = clicks.withWatermark("clicked_at", "1 day").alias("c")
    return left.join(
        right,
        F.expr(
            "o.session_id = c.session_id and o.product_id = c.product_id and c.clicked_at <= o.created_at "
            f"and c.clicked_at >= o.created_at - interval {days} days"
        ),
        "inner",
    ).select("o.order_id", "o.session_id", "o.product_id", "o.created_at", "c.clicked_at")


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Engagement counters per conversation, kept up to date."""
    return chat.accepted_feedback(feedback).groupBy("conversation_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event") == "product_click").alias("product_clicks"),
        F.count_if(F.col("event") == "add_to_cart").alias("add_to_carts"),
    )


def first_exposures(requests: DataFrame, definitions: DataFrame, bounds: DataFrame, delay: str = "1 day") -> DataFrame:
    """Requests to assigned exposures, one per (experiment, session) and watermark delay, with its time.

    State ends with the watermark, so a session that comes back after the delay gives another row; readers
    keep the earliest. ``definitions`` (one list per tenant) and ``bounds`` are static tables.
    """
    slotted = requests.withWatermark("ts", delay).withColumn("slot", F.col("ts")).withColumn("query", text.js_trim(F.lower("query")))
    hits = experiments.matched(slotted, definitions, "experiments", "targeting").filter("session_id <> ''")
    keyed = hits.select(
        "tenant", "session_id", "query", "ts", F.col("definition.id").alias("experiment_id")
    ).withColumn("bucket", matching.traffic_bucket(F.col("experiment_id"), F.col("session_id")))
    return experiments.assigned(keyed, bounds).dropDuplicatesWithinWatermark(["tenant", "experiment_id", "session_id"]).select(
        "tenant", "experiment_id", "session_id", "arm", "bucket", "ts"
    )


def _newest(table: DataFrame) -> DataFrame:
    """The rows of the newest version of every bucket; only partition columns are read to find them."""
    newest = table.groupBy("bucket").agg(F.max("version").alias("version")).collect()  # at most BUCKETS rows
    return table.filter(
        F.concat_ws("/", "bucket", "version").isin([f"{r['bucket']}/{r['version']}" for r in newest])
    )


def upserted_conversations(writes: DataFrame, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """Drain conversation writes into a table holding one row per conversation.

    Plain parquet has no merge: the table is cut into buckets by conversation, and a batch combines
    the newest version of the buckets it touches with its new rows and writes their version
    ``number + 1``. A replayed batch starts from what was there before it and overwrites only its own
    version. A restart with nothing new returns the table as it is. ``buckets`` belongs to the table
    and must stay the same for a folder.
    """
    spark = writes.sparkSession
    data = f"{folder}/data"
    row = chat.latest_conversations(spark.createDataFrame([], writes.schema)).schema
    stored = T.StructType([*row.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])

    def merge(batch: DataFrame, number: int) -> None:
        fresh = chat.latest_conversations(batch).withColumn("bucket", F.pmod(F.hash("conversation_id"), F.lit(buckets)))
        if number > 0:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS rows
            before = spark.read.schema(stored).parquet(data).filter(F.col("bucket").isin(touched) & (F.col("version") <= number))
            fields = [c for c in row.names if c not in ("conversation_id", "created_at", "updated_at")]
            fresh = (
                _newest(before).drop("version").unionByName(fresh)
                .groupBy("bucket", "conversation_id")
                .agg(
                    F.min("created_at").alias("created_at"),
                    F.max("updated_at").alias("updated_at"),
                    F.max_by(F.struct(*fields), F.struct("updated_at", "turns")).alias("last"),
                )
                .select("conversation_id", "created_at", "updated_at", "last.*", "bucket")
            )
        (
            fresh.withColumn("version", F.lit(number + 1).cast("long"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(data)
        )

    query = (
        writes.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )
    query.awaitTermination()
    try:
        table = spark.read.schema(stored).parquet(data)
    except AnalysisException as error:  # the source has never had a row
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], row)
    return _newest(table).select(*row.names)


def consumed_quota(hits: DataFrame, limit: int, window_seconds: int, delay: str = "1 day") -> DataFrame:
    """Quota per key with state (window opening, count) that ends with its window.

    ``hits(key, ts, hit_id)``. Hits of one micro-batch count in time order, micro-batches in the order
    of their arrival; hits later than the delay are dropped, as in every stream with a watermark. To
    be started with ``state_store=ROCKSDB``.
    """
    from vitrine.streaming.quota_state import QuotaProcessor

    schema = "key string, hit_id long, opened long, count long, allowed boolean"
    return (
        hits.withWatermark("ts", delay)
        .select("key", F.col("hit_id").cast("long").alias("hit_id"), F.unix_micros("ts").alias("at"), "ts")
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=QuotaProcessor(limit, window_seconds),
            outputStructType=schema,
            outputMode="append",
            timeMode="EventTime",
        )
    )
