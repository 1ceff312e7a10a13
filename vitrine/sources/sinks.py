"""Append log on plain parquet that takes each key once and opens only files that may hold a batch's keys.

A batch is written in buckets of the key's hash, `rows/batch=<id>/bucket=<n>`, and a Bloom filter of each bucket's
keys follows in `filters`. A later batch meets the filters of its buckets; only where a filter lets one of
its keys pass are that batch's and bucket's files read, and the keys compared. The filters are written last and
are what makes a batch part of the log: rows of a batch that was cut short are never read.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.operators.blocks import no_rows
from vitrine.session import checkpointed

BUCKETS = 64
#: Bits of a filter a key, and bits set for each key: one key in 20,000 passes by chance.
BITS, HASHES = 20, 10
_FILTERS = "batch string, bucket int, keys long, bits binary"


def _hash(keys: list[str], seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def _places(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """Bits of each key: HASHES steps from one hash by another."""
    step = two.astype(np.uint64) | np.uint64(1)
    return (one.astype(np.uint64)[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def _bloom(rows: pd.DataFrame) -> pd.DataFrame:
    size = max(64, BITS * len(rows))
    bits = np.zeros(size, bool)
    bits[_places(rows["one"].to_numpy(), rows["two"].to_numpy(), size).ravel()] = True
    return pd.DataFrame({"batch": [rows["batch"].iloc[0]], "bucket": [rows["bucket"].iloc[0]], "keys": [len(rows)], "bits": [np.packbits(bits).tobytes()]})


def _passed(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Batches of a bucket whose filter lets a key pass."""
    found = []
    for batch, bucket, n, bits in zip(filters["batch"], filters["bucket"], filters["keys"], filters["bits"], strict=True):
        size = max(64, BITS * n)
        if len(keys) and np.unpackbits(np.frombuffer(bits, np.uint8))[_places(keys["one"].to_numpy(), keys["two"].to_numpy(), size)].all(axis=1).any():
            found.append((batch, bucket))
    return pd.DataFrame(found, columns=["batch", "bucket"]) if found else no_rows("batch", bucket=int)


def _filters(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(_FILTERS).parquet(os.path.join(folder, "filters"))
    except AnalysisException:  # nothing has been appended
        return None


def _rows(spark: SparkSession, folder: str, schema, parts: list[str]) -> DataFrame:
    base = os.path.join(folder, "rows")
    return spark.read.schema(schema).option("basePath", base).parquet(*[os.path.join(base, p) for p in parts]).select(*[f.name for f in schema])


def append_new(rows: DataFrame, folder: str, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS) -> list[tuple[str, int]]:
    """Append the rows whose key the log does not hold yet; of rows with one key the first by ``order``.

    Gives the (batch, bucket) parts of the log that were read. They are as many as the log has at most, whatever its
    rows; with filters that pass one key in 20,000 by chance, few but those that hold a key again.
    """
    if {"batch", "bucket"} & set(rows.columns):
        raise ValueError("the log's folders are called batch and bucket, its columns may not be")
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*(order or keys))).alias("_row")).select("_row.*") if order else rows.dropDuplicates(keys)
    hashed = first.select("*", _hash(keys).alias("_one"), _hash(keys, 1).alias("_two"), F.pmod(_hash(keys, 2), F.lit(buckets)).cast("int").alias("bucket"))
    hashed = checkpointed(hashed)  # met with the filters, with the log, and written
    known, opened = _filters(spark, folder), []
    if known is not None:
        asked = hashed.select("bucket", F.col("_one").alias("one"), F.col("_two").alias("two"))
        opened = [tuple(r) for r in asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(_passed, "batch string, bucket int").collect()]
    fresh = hashed
    if opened:
        held = _rows(spark, folder, rows.schema, [os.path.join(f"batch={b}", f"bucket={n}") for b, n in opened])
        held = held.select(*[F.col(k).alias(f"_held_{i}") for i, k in enumerate(keys)])
        same = [F.col(k).eqNullSafe(F.col(f"_held_{i}")) for i, k in enumerate(keys)]
        fresh = hashed.join(held, same, "left_anti")
    fresh = checkpointed(fresh)
    fresh.drop("_one", "_two").repartition("bucket").write.partitionBy("bucket").parquet(os.path.join(folder, "rows", f"batch={batch}"))
    listed = fresh.select(F.lit(batch).alias("batch"), "bucket", F.col("_one").alias("one"), F.col("_two").alias("two"))
    listed.groupBy("bucket").applyInPandas(_bloom, _FILTERS).write.mode("append").parquet(os.path.join(folder, "filters"))
    return opened


def read_log(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows of a log; an empty frame where nothing has been appended."""
    known = _filters(spark, folder)
    batches = [] if known is None else sorted(r.batch for r in known.select("batch").distinct().collect())
    if not batches:
        return spark.createDataFrame([], schema)
    return _rows(spark, folder, schema, [f"batch={b}" for b in batches])
