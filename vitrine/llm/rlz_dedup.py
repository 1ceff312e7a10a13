"""Substring deduplication by relative Lempel-Ziv parsing.

A word is removed if it lies in a window of 50 words whose word sequence also starts in a document with a smaller id.

Reference blocks. Each window chooses the smallest hash among its runs of eight words, its anchor. Windows of a document
that follow each other and have the same anchor make one block, which spans all words of these windows. Wherever a
window recurs, it has the same anchor, so blocks of all documents are the reference, indexed by anchor: equal windows are always
found in blocks of the same anchor.

Parsing. A block whose anchor is in one document only matches nothing. If all blocks of an anchor are equal, the block
is matched whole by the earliest document that has it. At a factor's boundaries the blocks of an anchor differ; of equal blocks
all but the earliest document's are again matched whole, and the distinct blocks are compared by the windows inside
them: the first place of every window is looked up. Matches that follow each other in the document and in the same reference
join, so they extend over block boundaries to both sides as far as document and reference agree in whole windows. The
parse is greedy: at each place the factor that reaches farthest is taken, the next one begins where it ends. A document's factors,
(document, start, length, reference document, reference start), are cut out of it.

Scale: what is shuffled is one row a block (about one in 22 words), the windows of distinct boundary blocks, and the texts twice, for the
boundary check and for the cutting. Frequent passages only lengthen sums that are formed on the map
side, or a join that Spark splits; no task holds all rows of an anchor. Words, windows and blocks are compared by 64-bit hashes, an
anchor together with a block or window hash.

Null text: no words. A null id is neither smaller nor larger than any: nothing is removed there, nor because of it. Rows that repeat an id are not
smaller than each other, so they stay alike; each gives its row. Matches belong to an id and a text, so rows with one id and different texts do not share them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import by_batch, lists, longs, stored, texts
from vitrine.llm.wordtape import mixed, powers, ranges, rolling, slices, tape

WINDOW = 50
ANCHOR = 8

_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(x) - width + 1
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def parsed(start: np.ndarray, n: np.ndarray, reference: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, word after the last, reference, its first word) of a text's matches.

    A match says that the n windows from `start` on are those of `reference` from `at` on.
    """
    order = np.lexsort((start, at - start, reference))
    start, n, reference, at = (x[order].astype(np.int64) for x in (start, n, reference, at))
    # matches of one reference at one distance, whose windows overlap or touch, are one
    end, shift = start + n, at - start
    same = (reference[1:] == reference[:-1]) & (shift[1:] == shift[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    reach = end + group * (int(end.max()) + 1)  # running maximum inside a group
    reach = np.maximum.accumulate(reach) - group * (int(end.max()) + 1)
    first = np.concatenate([[True], ~same | (start[1:] > reach[:-1])])
    lo = np.flatnonzero(first)
    starts, ends = start[lo], reach[np.append(lo[1:], len(start)) - 1] - 1 + window
    order = np.argsort(starts, kind="stable")
    out, best, p = [], -1, -1
    candidates = [(int(starts[i]), int(ends[i]), int(reference[lo[i]]), int(shift[lo[i]])) for i in order]
    i = 0
    while i < len(candidates) or best >= 0:
        while i < len(candidates) and candidates[i][0] <= p:
            if best < 0 or candidates[i][1] > candidates[best][1]:
                best = i
            i += 1
        if best >= 0 and candidates[best][1] > p:
            _, stop, doc, by = candidates[best]
            out.append((p, stop, doc, p + by))
            p = stop
        elif i < len(candidates):
            p, best = candidates[i][0], -1
        else:
            break
    return out


class Sums:
    """Hashes of any runs of words, from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.back = powers(_BACK, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(_STEP, n), out=self.total[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.total[hi] - self.total[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


def _blocks(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """Text, first window (in words of the text), number of windows, anchor and content hash of each block."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    starts = ranges(first[:-1], count)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    text = np.repeat(np.arange(len(count)), count)
    least = sliding_min(rolling(hashes, anchor), window - anchor + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    content = Sums(hashes).of(starts[at], starts[at] + n - 1 + window)
    return text[at], starts[at] - first[text[at]], n, least[at], content


def _index(window: int, anchor: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, parts = [], []
        for _, _, data, offsets in slices(batch.column("text")):
            words = tape(data, offsets)
            text, start, n, least, content = _blocks(words.hashes(), words.first, window, anchor)
            counts.append(np.bincount(text, minlength=len(offsets) - 1))
            parts.append((least, content, start, n))
        least, content, start, n = (np.concatenate(p) for p in zip(*parts, strict=True))
        struct = pa.StructArray.from_arrays([longs(least), longs(content), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "content", "start", "n"])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists(struct, np.concatenate(counts))], ["doc_id", "key", "blocks"])

    return by_batch(run)


def _windows(window: int):
    """Windows of listed blocks, with their hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        blocks = batch.column("blocks")
        parts = []
        for lo, hi, data, offsets in slices(batch.column("text")):
            own = blocks.slice(lo, hi - lo)
            n_own = np.diff(own.offsets.to_numpy())
            if not n_own.any():
                continue
            words = tape(data, offsets)
            flat = own.flatten()
            text = np.repeat(np.arange(hi - lo), n_own)
            start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            least = flat.field("anchor").to_numpy()
            at = ranges(words.first[:-1][text] + start, n)
            parts.append((np.repeat(lo + text, n), np.repeat(least, n), Sums(words.hashes()).of(at, at + window).view(np.int64), at - words.first[:-1][np.repeat(text, n)]))
        if not parts:
            return None
        text, least, content, start = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(c).take(pa.array(text)) for c in ("doc_id", "key")] + [pa.array(least), pa.array(content), pa.array(start.astype(np.int32))],
            ["doc_id", "key", "anchor", "content", "start"],
        )

    return by_batch(run)


def _cut(window: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matched = batch.column("matched")
        n_words, n_removed, digests, factors, n_factors = [], [], [], [], []
        for lo, hi, data, offsets in slices(batch.column("text")):
            own = matched.slice(lo, hi - lo)
            n_own = np.diff(own.offsets.to_numpy())
            before = np.cumsum(n_own) - n_own
            flat = own.flatten()
            starts, ns, references, places = (flat.field(c).to_numpy() for c in ("start", "n", "reference", "at"))
            raw = data.tobytes()
            for i in range(hi - lo):
                words = raw[offsets[i] : offsets[i + 1]].split()
                removed, mine = 0, []
                if n_own[i]:
                    s, n = starts[before[i] : before[i] + n_own[i]], ns[before[i] : before[i] + n_own[i]]
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, s, 1)
                    np.add.at(change, np.minimum(s + n - 1 + window, len(words)), -1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed = int(gone.sum())
                    mine = parsed(s, n, references[before[i] : before[i] + n_own[i]], places[before[i] : before[i] + n_own[i]], window)
                    total = len(words)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    total = len(words)
                n_words.append(total)
                n_removed.append(removed)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                factors += mine
                n_factors.append(len(mine))
        parts = np.array(factors, np.int64).reshape(-1, 4)
        struct = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(4)], ["word_start", "word_end", "reference", "reference_start"])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), lists(struct, np.array(n_factors))],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"],
        )

    return by_batch(run)


_BLOCK = "struct<anchor:long,content:long,start:int,n:int>"


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank), factors.

    factors: word_start, word_end, reference (a smaller doc_id; of rows that repeat it, one), reference_start. They cover
    the removed words, without overlap.
    """
    # the key of a row: its id and text; rows without an id match no list, and are not all dealt to one task
    source = texts(docs).withColumn("key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), F.xxhash64("text")))
    indexed = stored(source.where(F.col("doc_id").isNotNull()).mapInArrow(_index(window, anchor), f"doc_id long, key string, blocks array<{_BLOCK}>"))
    blocks = indexed.select("doc_id", "key", F.explode("blocks").alias("b")).select("doc_id", "key", "b.*")
    # looked-up tables are written first: a join of two exchanges is one whose hot keys Spark can split
    anchors = stored(
        blocks.groupBy("anchor")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"), F.min("content").alias("low"), F.max("content").alias("high"))
        .where(F.col("first.doc_id") < F.col("last")).select("anchor", "first", (F.col("low") != F.col("high")).alias("varied"))
    )
    shared = stored(blocks.join(anchors, "anchor"))
    match = ("key", "start", "n", F.col("first.doc_id").alias("reference"), F.col("first.start").alias("at"))
    later = F.col("doc_id") > F.col("first.doc_id")
    whole = shared.where(~F.col("varied") & later).select(*match)
    varied = shared.where("varied").drop("first", "varied")
    firsts = stored(varied.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "start")).alias("first")))
    known = varied.join(firsts, ["anchor", "content"])
    equal = known.where(later).select(*match)
    edges = known.where(F.col("doc_id") == F.col("first.doc_id")).groupBy("key").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("blocks"))
    windows = stored(
        source.join(edges, "key", "left").select("doc_id", "key", "text", F.coalesce("blocks", F.array().cast("array<struct<anchor:long,start:int,n:int>>")).alias("blocks"))
        .mapInArrow(_windows(window), "doc_id long, key string, anchor long, content long, start int")
    )
    earliest = stored(windows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last")).where(F.col("first.doc_id") < F.col("last")))
    single = windows.join(earliest, ["anchor", "content"]).where(later).withColumn("n", F.lit(1)).select(*match)
    matched = whole.unionByName(equal).unionByName(single).groupBy("key").agg(F.collect_set(F.struct("start", "n", "reference", "at")).alias("matched"))
    return (
        source.join(matched, "key", "left")
        .select("doc_id", "text", F.coalesce("matched", F.array().cast("array<struct<start:int,n:int,reference:long,at:int>>")).alias("matched"))
        .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<word_start:long,word_end:long,reference:long,reference_start:long>>")
    )
