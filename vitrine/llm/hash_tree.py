"""Sharding by a hierarchical weighted hash tree, in Spark SQL functions only.

Shards hang on a tree of regions and racks. A row descends it: at each node every child draws -ln(u) / weight, with u
in (0, 1] a hash of the row's id and the child's name, and the smallest draw wins; a node's weight is its number of
shards. When a weight changes, only rows that the changed subtree wins or loses move. Shards are numbered so that
regions fill one after the other: with whole regions in use one more shard opens a region of its own, no other weight changes, and
rows move into the new shard only (law `key`).

Slots number the rows of a shard without gaps. A shard is cut into `CHUNKS` chunks by a hash of the id; rows are
numbered inside a chunk, and chunks start at the running count of the chunks before. No task holds a whole shard.

Null id: treated as the empty text. Null text: size 16, CRC of no bytes. Repeated rows fall in the same shard and get
slots of their own; rows with the same id are ordered by size and CRC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.llm.common import id_text, stored

SHARDS = 40
CHUNKS = 1024
SHARDS_IN_RACK, RACKS_IN_REGION = 4, 2


def weights(shards: int) -> tuple[list[int], list[int]]:
    """Shards below each region and below each rack, racks and regions filled in order."""
    per_region = SHARDS_IN_RACK * RACKS_IN_REGION
    regions = [min(per_region, shards - i) for i in range(0, shards, per_region)]
    racks = [max(0, min(SHARDS_IN_RACK, shards - i)) for i in range(0, len(regions) * per_region, SHARDS_IN_RACK)]
    return regions, racks


def draw(key: Column, level: str, number: Column, weight: Column) -> Column:
    """(draw, number): an exponential draw of the given rate from 52 bits of a digest; null at weight 0."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{level}"), number.cast("string"))), 1, 13), 16, 10).cast("double")
    return F.when(weight > 0, F.struct((-F.log((bits + 1) / F.lit(float(1 << 52))) / weight.cast("double")).alias("d"), number.alias("i")))


def smallest(key: Column, level: str, first: Column, children: int, below: list[int]) -> Column:
    """Number of the child of smallest draw; children are numbered from `first`; `below` has the weights of the level."""
    weight = F.array(*map(F.lit, below))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(children - 1)), lambda k: (first + k).cast("int"))
    return F.array_min(F.transform(numbers, lambda n: draw(key, level, n, F.coalesce(F.get(weight, n), F.lit(0)))))["i"]


def descend(rows: DataFrame, key: str, shards: int, into: str) -> DataFrame:
    """The rows with the shard that each key reaches."""
    regions, racks = weights(shards)
    return (
        rows.withColumn("_region", smallest(F.col(key), "r", F.lit(0), len(regions), regions))
        .withColumn("_rack", smallest(F.col(key), "k", F.col("_region") * RACKS_IN_REGION, RACKS_IN_REGION, racks))
        .withColumn(into, smallest(F.col(key), "s", F.col("_rack") * SHARDS_IN_RACK, SHARDS_IN_RACK, [1] * shards))
        .drop("_region", "_rack")
    )


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    if shards % (SHARDS_IN_RACK * RACKS_IN_REGION):
        raise ValueError("regions must be full for one more shard to open its own")
    key = id_text(F.col("doc_id").cast("long"))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), key.alias("key"),
        (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % CHUNKS).cast("int").alias("chunk"),
    )
    # small rows without the texts, which are numbered and counted: written so that texts are read once
    placed = stored(descend(descend(placed, "key", shards, "shard"), "key", shards + 1, "grown_shard"), "placed")
    inner = Window.partitionBy("chunk", "shard").orderBy("doc_id", "size", "text_crc32")
    counted = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return (
        placed.withColumn("place", F.row_number().over(inner)).join(starts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"), "grown_shard")
    )
