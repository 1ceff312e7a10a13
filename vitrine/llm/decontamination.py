"""Benchmark decontamination with an Aho-Corasick automaton.

A text is lower-cased (A-Z) and cut into words, runs of digits, letters a-z and non-ASCII bytes. A window is ten
consecutive words of a benchmark item, or the whole of a shorter item. The windows of all items are the patterns of one
automaton over the words joined by blanks, with a blank at each end; every document is run through it once. A match's place in the
normalised text gives its words, and as folding keeps byte positions, a word's place in the original bytes.

The automaton is held by each worker, so its size is bounded: a benchmark of more than `WINDOWS` windows is dealt by
hash into blocks of about that size, each with an automaton and a scan of its own, and the hits of all blocks are united.
Which items own a window is joined by Spark afterwards; a window shared by many items is one pattern.

Null text or a text without words: no words, no hits; an item without words has no window. An item with a null id
marks words but is not listed or counted; items that repeat an id count once. Each repeated document row gives its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import by_batch, lists, texts, whole_rows
from vitrine.llm.wordtape import text_buffer

WIDTH = 10
#: Windows of one automaton.
WINDOWS = 100_000

_FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (window, item): the window's words joined by blanks, as UTF-8 bytes."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows, counts = [], []
        for text in batch.column("text").to_pylist():
            words = text.encode().translate(_FOLD).split()
            own = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
            windows += sorted(own)
            counts.append(len(own))
        owner = pa.array(np.repeat(np.arange(len(counts)), counts))
        return pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), batch.column("item").take(owner)], ["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return items.mapInArrow(by_batch(cut), "window binary, item string").distinct()


class Matcher:
    """One automaton; patterns and texts are bytes read as one character each."""

    def __init__(self, windows: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for number, window in enumerate(windows):
            self.automaton.add_word(f" {window.decode('latin-1')} ", (number, len(window)))
        if windows:
            self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, int, int]], set[int]]:
        """Words of the text; merged hits as (first word, word after the last, first byte, byte after the last); windows."""
        folded = raw.translate(_FOLD)
        words = folded.split()
        if not words or not len(self.automaton):
            return len(words), [], set()
        hits = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not hits:
            return len(words), [], set()
        sizes = np.array([len(w) for w in words])
        joined = np.cumsum(sizes + 1) - sizes  # start of each word in the padded, joined text
        inside = np.frombuffer(folded, np.uint8) != 0x20
        begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        spans: list[list[int]] = []
        for last, first in sorted((end, end - size) for end, (_, size) in hits):
            lo, hi = int(np.searchsorted(joined, first)), int(np.searchsorted(joined, last))
            while spans and spans[-1][0] >= lo:
                hi = max(hi, spans.pop()[1])
            if spans and spans[-1][1] >= lo:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        return (
            len(words),
            [(lo, hi, int(begins[lo]), int(begins[hi - 1] + sizes[hi - 1])) for lo, hi in spans],
            {number for _, (number, _) in hits},
        )


_SPAN = "struct<word_start:long,word_end:long,byte_start:long,byte_end:long>"


def _scan(docs: DataFrame, windows: list[bytes], block: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    held: dict[int, Matcher] = {}

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        if 0 not in held:
            held[0] = Matcher(shared.value)
        data, offsets = text_buffer(batch.column("text"))
        n_words, spans, found, n_spans, n_found = [], [], [], [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n, own, numbers = held[0].scan(data[lo:hi].tobytes())
            n_words.append(n)
            spans += own
            n_spans.append(len(own))
            found += [shared.value[k] for k in sorted(numbers)]
            n_found.append(len(numbers))
        parts = np.array(spans, np.int64).reshape(-1, 4)
        struct = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(4)], ["word_start", "word_end", "byte_start", "byte_end"])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("mark"), pa.array(n_words, pa.int64()), lists(struct, np.array(n_spans)),
                lists(pa.array(found, pa.binary()), np.array(n_found)), pa.array(np.full(len(n_words), int(block == 0))),
            ],
            ["doc_id", "mark", "n_words", "spans", "windows", "copies"],
        )

    return docs.mapInArrow(by_batch(find), f"doc_id long, mark long, n_words long, spans array<{_SPAN}>, windows array<binary>, copies long")


def _merged(spans: F.Column) -> F.Column:
    """Sorted spans with those that touch or overlap made one."""

    def add(done: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["word_start"].alias("word_start"), F.greatest(last["word_end"], x["word_end"]).alias("word_end"),
            last["byte_start"].alias("byte_start"), F.greatest(last["byte_end"], x["byte_end"]).alias("byte_end"),
        )
        new = F.when((F.size(done) > 0) & (last["word_end"] >= x["word_start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))
        return new.otherwise(F.concat(done, F.array(x)))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), F.array().cast(f"array<{_SPAN}>"), add))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (of words and of original bytes), mark (a hash of the text)."""
    windows = item_windows(benchmark, width)
    distinct = windows.select("window").distinct()
    blocks = max(1, -(-distinct.count() // block_windows))
    source = texts(docs).withColumn("mark", F.xxhash64("text"))
    scans = None
    for block in range(blocks):
        mine = distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).toArrow().column("window").to_pylist()
        scan = _scan(source, sorted(mine), block)
        scans = scan if scans is None else scans.unionByName(scan)
    # rows that repeat an id and a text are alike; they are counted here and dealt out again below
    found = scans.groupBy("doc_id", "mark", "n_words").agg(
        F.sum("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("windows"))).alias("windows"),
    )
    key = ["doc_id", "mark", "n_words", "copies", "spans"]
    listed = (
        found.select(*key, F.explode_outer("windows").alias("window")).join(windows, "window", "left")
        .groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    spans = _merged(F.col("spans"))
    hit = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda n, x: n + x["word_end"] - x["word_start"])
    return (
        listed.withColumn("spans", spans).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "items", "spans", "mark",
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window occurs, with all their columns, whatever these are called, and repeats."""
    found = decontaminate(docs, benchmark)
    hits = found.where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark")).distinct()
    return whole_rows(docs).join(hits, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_mark") == F.col("hit_mark")), "left_anti").select("row.*")
