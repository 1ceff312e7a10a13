"""Substring deduplication with suffix orders of shards.

A byte is removed if a string of 400 bytes that covers it also starts anywhere else, in the same or another document.

Shards. Each string of 400 bytes chooses the leftmost least hash among its substrings of `anchor` bytes. Neighbouring
strings with the same choice make a block, at most 400 - anchor + 1 of them. Equal strings choose alike, so they lie in
blocks of equal anchors; a block whose anchor occurs once in the corpus holds no repeated string. Blocks of the other
anchors are dealt by anchor into shards, equal blocks once, with their number. Every shard is put in suffix order by
external induced sorting (`induced_sorting`), and a string repeats if its common prefix with a neighbour in that order
reaches 400 bytes, or if its block has several copies.

Hot anchors. The blocks of an anchor with more than `hot_bytes` of different blocks are not one task's work: they are cut
again by longer anchors, halfway to 400 each time, and treated as texts of their own. At 400 bytes an anchor is the
string itself and has one block, so every group ends up below the bound.

Data flow. Equal texts are one unit, merged on the map side. Units are written once, bucketed by their key, so that the
two later joins (blocks to cut out, spans to remove) shuffle lists of places and never the texts. What is shuffled is
one row a block (about 1 in 137 bytes) and the bytes of different blocks of shared anchors. No join has a hot key on
both sides. Blocks are compared by two 64-bit hashes, texts by 128 bits of a digest; bytes by the suffix order.

Null text: empty, nothing removed. Ids play no part: rows that repeat an id, and null ids, are documents of their own,
and rows of equal texts get equal results. A text shorter than 400 bytes stays. Periodic texts overlap themselves and go.
Very long texts are indexed as one slice of memory. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import by_batch, lists, longs, stored, texts
from vitrine.llm.induced_sorting import MEMORY, Space, repeated
from vitrine.llm.rlz_dedup import Sums, sliding_min
from vitrine.llm.wordtape import _BYTE_CODES, SLICE_BYTES, ranges
from vitrine.session import run_folder

WINDOW = 400
ANCHOR = 128
#: Bytes of different blocks in a shard, and of one anchor before it is cut further.
SHARD_BYTES, HOT_BYTES = 4 << 20, 1 << 20

_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_BLOCK = "struct<anchor:long,content:long,start:int,n:int>"
_RUNS = "array<struct<start:int,n:int>>"


def buffers(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of whole byte strings of about SLICE_BYTES: first row, row after the last, bytes, offsets into these."""
    column = column.cast(pa.large_binary())
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = min(len(column), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _index(window: int, anchor: int):
    """Blocks of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, parts = [], []
        for _, _, data, offsets in buffers(batch.column("text")):
            n = np.maximum(np.diff(offsets) - window + 1, 0)
            counts.append(np.zeros(len(n), np.int64))
            starts = ranges(offsets[:-1], n)
            if not len(starts):
                continue
            sums, text = Sums(_BYTE_CODES[data]), np.repeat(np.arange(len(n)), n)
            at = np.arange(len(data) - anchor + 1)
            codes = sums.of(at, at + anchor)
            place = sliding_min(codes & _HIGH | at.astype(np.uint64), window - anchor + 1)[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(starts)))
            counts[-1] = np.bincount(text[first], minlength=len(n))
            parts.append((codes[(place[first] & _LOW).astype(np.int64)], sums.of(starts[first], starts[first] + size - 1 + window), starts[first] - offsets[text[first]], size))
        none = np.empty(0, np.uint64)
        codes, content, start, size = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (none, none, none, none)
        struct = pa.StructArray.from_arrays([longs(codes), longs(content), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["anchor", "content", "start", "n"])
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), lists(struct, np.concatenate(counts))], ["key", "copies", "blocks"])

    return by_batch(run)


def _bytes(window: int):
    """The bytes of listed blocks of a text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("blocks")
        row = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
        flat = own.flatten()
        start, n = (flat.field(x).to_pylist() for x in ("start", "n"))
        column = batch.column("text")
        cut, held, at = [], b"", -1
        for r, s, k in zip(row.tolist(), start, n, strict=True):
            if r != at:
                held, at = column[r].as_py(), r
            cut.append(held[s : s + k - 1 + window])
        return pa.RecordBatch.from_arrays([*(flat.field(x) for x in ("anchor", "content", "copies")), pa.array(cut, pa.binary())], ["anchor", "content", "copies", "bytes"])

    return by_batch(run)


def _order(window: int, memory: int):
    """Runs of repeated strings in each block of a shard, which is the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, kept, sizes = Space(memory), [], []
        with space.file() as file:
            for batch in batches:  # blocks as letters 2 to 255 (UTF-8 has no higher bytes than 0xF7), a 1 after each
                for lo, hi, data, offsets in buffers(batch.column("bytes")):
                    length = np.diff(offsets)
                    out = np.ones(len(data) + hi - lo, np.uint8)
                    out[np.arange(len(data)) + np.repeat(np.arange(hi - lo), length)] = data + 2
                    file.write(out.tobytes())
                    sizes.append(length.astype(np.int32))
                kept.append(batch.select(["anchor", "content", "copies"]))
            if not sizes:
                return
            file.write(b"\0")
            file.flush()
            text = np.memmap(file, np.uint8, "r")
            if len(text) <= memory:
                text = np.array(text)
        flags, size = repeated(text, 256, window, space), np.concatenate(sizes).astype(np.int64)
        begin = np.cumsum(size + 1) - size - 1
        several = np.concatenate([b.column("copies").to_numpy() for b in kept]) > 1
        done = 0
        for batch in kept:
            lo, hi = done, done + batch.num_rows
            done = hi
            starts, ns, counts = [], [], []
            for at, length, copied in zip(begin[lo:hi], size[lo:hi], several[lo:hi], strict=True):
                own = np.ones(length - window + 1, bool) if copied else np.asarray(flags[at : at + length - window + 1])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2)
                starts.append(edges[:, 0])
                ns.append(edges[:, 1] - edges[:, 0])
                counts.append(len(edges))
            struct = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ns)], ["start", "n"])
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("content"), lists(struct, np.array(counts, np.int64))], ["anchor", "content", "runs"])

    return run


def _cut(window: int):
    """What is left of each text without the strings of the listed runs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("runs")
        edges = own.offsets.to_numpy() - own.offsets[0].as_py()
        flat = own.flatten()
        starts, ns = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
        column = batch.column("text")
        total, removed, digests, spans, counts = [], [], [], [], []
        for i in range(batch.num_rows):
            data = column[i].as_py()
            total.append(len(data))
            mine = np.empty((0, 2), np.int64)
            if edges[i] < edges[i + 1]:
                change = np.zeros(len(data) + 1, np.int32)
                s, n = starts[edges[i] : edges[i + 1]], ns[edges[i] : edges[i + 1]]
                np.add.at(change, s, 1)
                np.add.at(change, s + n - 1 + window, -1)
                gone = np.cumsum(change)[:-1] > 0
                mine = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                data = np.frombuffer(data, np.uint8)[~gone].tobytes()
            removed.append(total[-1] - len(data))
            digests.append(hashlib.sha256(data).hexdigest())
            spans.append(mine)
            counts.append(len(mine))
        at = np.concatenate(spans)
        struct = pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["byte_start", "byte_end"])
        n = np.array(counts, np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(n), pa.array(digests, pa.string()), lists(struct, n)],
            ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )

    return by_batch(run)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as a table in the shared folder that joins by `key` read in place, without a shuffle."""
    spark, name = df.sparkSession, f"units_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("compression", "zstd").saveAsTable(name, format="parquet", path=run_folder(spark, "units"))
    return spark.table(name)


def merged(rows: DataFrame) -> DataFrame:
    """Units: key, copies, text (bytes) of different texts."""
    return bucketed(rows.groupBy("key").agg(F.sum("copies").alias("copies"), F.first("text").alias("text")), "key")


def _with_lists(units: DataFrame, rows: DataFrame, into: str, *columns: str) -> DataFrame:
    return units.join(rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias(into)), "key")


def repeats(units: DataFrame, window: int, anchor: int, shard_bytes: int, hot_bytes: int, memory: int) -> DataFrame:
    """key, start, n: runs of consecutive places of a unit where repeated strings start; runs may meet, not overlap."""
    blocks = stored(units.mapInArrow(_index(window, anchor), f"key binary, copies long, blocks array<{_BLOCK}>"), "blocks", compression="zstd")
    blocks = blocks.select("key", "copies", F.explode("blocks").alias("b")).select("key", "copies", "b.*")
    # looked-up tables are written first: a join of two exchanges is one whose hot keys Spark can split
    anchors = stored(blocks.groupBy("anchor").agg(F.sum("copies").alias("n_found")).where(F.col("n_found") > 1).select("anchor"), "anchors")
    shared = stored(blocks.join(anchors, "anchor"), "shared", compression="zstd")
    different = stored(shared.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "start", "n")).alias("one")), "different")
    size = F.col("one.n").cast("long") + window - 1
    total = different.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = stored(different.groupBy("anchor").agg(F.sum(size).alias("bytes")).where((F.col("bytes") > hot_bytes) & F.lit(anchor < window)).select("anchor"), "hot")

    def cut_out(chosen: DataFrame) -> DataFrame:
        listed = chosen.select(F.col("one.key").alias("key"), "one.start", "one.n", "anchor", "content", "copies")
        return _with_lists(units, listed, "blocks", "start", "n", "anchor", "content", "copies").select("text", "blocks").mapInArrow(
            _bytes(window), "anchor long, content long, copies long, bytes binary"
        )

    shards = max(1, -(-total // shard_bytes))
    runs = (
        cut_out(different.join(hot, "anchor", "left_anti")).repartition(shards, "anchor")
        .mapInArrow(_order(window, memory), f"anchor long, content long, runs {_RUNS}").where(F.size("runs") > 0)
    )
    if not hot.isEmpty():
        named = cut_out(different.join(hot, "anchor")).select(
            F.unhex(F.concat(F.lpad(F.hex("anchor"), 16, "0"), F.lpad(F.hex("content"), 16, "0"))).alias("key"), "copies", F.col("bytes").alias("text")
        )
        finer = repeats(bucketed(named, "key"), window, anchor + -(-(window - anchor) // 2), shard_bytes, hot_bytes, memory)
        names = different.join(hot, "anchor").select("anchor", "content", F.unhex(F.concat(F.lpad(F.hex("anchor"), 16, "0"), F.lpad(F.hex("content"), 16, "0"))).alias("key"))
        runs = runs.unionByName(names.join(finer.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "key").select("anchor", "content", "runs"))
    found = shared.select("key", "anchor", "content", F.col("start").alias("at")).join(stored(runs, "runs"), ["anchor", "content"])
    return found.select("key", "at", F.explode("runs").alias("r")).select("key", (F.col("at") + F.col("r.start")).alias("start"), F.col("r.n").alias("n"))


def deduplicate(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES, memory: int = MEMORY
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the kept bytes), spans (byte ranges cut out)."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor lies inside the window")
    content = F.col("text").cast("binary")
    rows = texts(docs).select("doc_id", F.unhex(F.substring(F.sha2(content, 256), 1, 32)).alias("key"), content.alias("text"))
    units = merged(rows.select("key", "text", F.lit(1).cast("long").alias("copies")))
    found = repeats(units, window, anchor, shard_bytes, hot_bytes, memory)
    listed = found.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    results = units.join(listed, "key", "left").select("key", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs")).mapInArrow(
        _cut(window), "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<byte_start:long,byte_end:long>>"
    )
    return rows.select("doc_id", "key").join(stored(results, "cut"), "key").drop("key")
