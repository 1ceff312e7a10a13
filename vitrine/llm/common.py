"""Reading of the given tables and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.session import run_folder

#: Upper-case ASCII letters and what they become; other letters stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(doc_id: Column) -> Column:
    """The id as text; null is the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(id_text(doc_id)) % F.lit(modulus)


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text of the documents, null texts empty, and nothing else but the columns asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each document as one value, `row`, beside its id, `own_id`, and a hash of its text, `own_mark`.

    No column of the documents can then clash with one that an operator adds, whatever it is called.
    """
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("own_mark"))


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return run


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column whose row i holds the next counts[i] values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the signed ones with the same bits."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def stored(df: DataFrame, name: str = "llm", **options: object) -> DataFrame:
    """The rows as a table written to the folder that all executors share, which cuts lineage and survives them."""
    folder = run_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches in which equal keys are together; each run is one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi == lo:
                continue
            if held and held[0].column(key)[0].as_py() != keys[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
