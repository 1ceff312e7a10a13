"""Scoring of texts by context-tree weighting over bytes, beside a unigram score of their words.

The model predicts each byte of a lower-cased (A-Z) text, and an end byte 0, from the `DEPTH` bytes before it (0 before the start). A byte is
eight binary decisions; every decision has a context tree of its own, whose nodes hold Krichevsky-Trofimov estimates.
A node's weighted probability is the mean of its own estimate and of its children's product; the conditional
probability that follows mixes the estimates of all depths. code_bits_per_byte is the code length per byte.

The tree is the whole one: every context of the training texts is in it, so it grows with them. Spark counts all
(DEPTH + 1)-grams and spreads the distinct ones by the last `ROOT` bytes of their contexts; all nodes deeper than that
are then inside one task. A first pass weights these subtrees upwards and leaves sums for the nodes of the last byte, at
most 65,280 whatever the corpus; the driver weights these and the root. A second pass goes down again and gives each
distinct gram, those of unlearned texts included, its log probability. Texts are scored from that table: the most frequent
grams, at most `HEAD_GRAMS`, are sent to the workers, the others are joined by Spark.

The unigram score needs the count of every word and goes the same way: at most `HEAD` words are sent, the others
joined. Words are told apart by 64-bit hashes.

Null text: no words, only the end. Null id: hashed as the empty text, so held out. Without training texts all counts are zero and
bits cost one bit each. Repeated rows are each learned from and scored. Memory: one slice of texts, the bounded tables, and
about `PART_GRAMS` distinct grams with their nodes in a task of the two passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import by_batch, id_remainder, lists, longs, stored, texts
from vitrine.llm.wordtape import mixed, ranges, slices, tape

DEPTH = 5
#: Bytes of context by which the tree is cut into tasks.
ROOT = 2
#: Distinct grams of a task, on average.
PART_GRAMS = 100_000
HEAD = 1 << 19
HEAD_GRAMS = 1 << 20
FOLDS = 10
#: Bytes of texts handled at once: a byte takes 44 in the arrays of its gram and in looking it up alone.
SLICE = 1 << 18
#: Distinct keys that a task has met since it last summed them, and those that it holds at most after that.
FRESH, HELD = 1 << 20, 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EMPTY = np.uint64(2**64 - 1)


class Table:
    """Open-addressed hash table of distinct integer keys with float columns, for whole arrays at once."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        keys = keys.astype(np.uint64)
        self.mask = np.uint64((1 << max(4, int(1.4 * len(keys)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, _EMPTY, np.uint64)
        self.columns = [np.zeros(int(self.mask) + 1, c.dtype) for c in columns]
        left, place = np.arange(len(keys)), mixed(keys) & self.mask
        while len(left):
            free = np.flatnonzero(self.keys[place[left]] == _EMPTY)
            spots, own = np.unique(place[left[free]], return_index=True)
            won = left[free[own]]
            self.keys[spots] = keys[won]
            for held, column in zip(self.columns, columns, strict=True):
                held[spots] = column[won]
            rest = np.ones(len(left), bool)
            rest[free[own]] = False
            left = left[rest]
            place[left] = (place[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not held."""
        place = mixed(keys) & self.mask
        held = self.keys[place]
        out = np.where(held == keys, place.astype(np.int64), -1)
        open_ = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(open_):
            place[open_] = (place[open_] + np.uint64(1)) & self.mask
            held = self.keys[place[open_]]
            same = held == keys[open_]
            out[open_[same]] = place[open_[same]]
            open_ = open_[~same & (held != _EMPTY)]
        return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the last DEPTH + 1 bytes at each position of the texts, ends included, and the first position of each text."""
    sizes = np.diff(offsets)
    n = len(sizes)
    padded = np.zeros(len(data) + n * (DEPTH + 1), np.uint64)
    begin = offsets[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH
    padded[ranges(begin, sizes)] = _LOWER[data]
    code = padded.copy()
    for k in range(1, DEPTH + 1):
        code[k:] |= padded[:-k] << np.uint64(8 * k)
    positions = ranges(begin, sizes + 1)
    return code[positions], offsets[:-1] + np.arange(n)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - np.uint64(1))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = tape(_LOWER[data], offsets)
    return words.hashes() >> np.uint64(1), words.first


def counts(docs: DataFrame) -> DataFrame:
    """(key, n) of rows (text, held_out).

    Words of training texts by their hash of 63 bits; grams of all texts by -1 - (code * 2 + 1 if held out).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}

        def emit(of_words: bool) -> Iterator[pa.RecordBatch]:
            if held[of_words]:
                keys, n = _summed(held[of_words])
                keys = keys.view(np.int64) if of_words else -1 - keys.view(np.int64)
                for lo in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], ["key", "n"])
                held[of_words] = []

        fresh = {True: 0, False: 0}
        for batch in batches:
            out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint64)
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
                words, first = _word_keys(data, offsets)
                learned = words[np.repeat(out[lo:hi], np.diff(first)) == 0]
                code = (_grams(data, offsets)[0] << np.uint64(1)) | np.repeat(out[lo:hi], np.diff(offsets) + 1)
                for of_words, keys in ((True, learned), (False, code)):
                    held[of_words].append(np.unique(keys, return_counts=True))
                    fresh[of_words] += len(held[of_words][-1][0])
                    if fresh[of_words] > FRESH:
                        held[of_words] = [_summed(held[of_words])]
                        fresh[of_words] = 0
                        if len(held[of_words][0][0]) > HELD:
                            yield from emit(of_words)
        yield from emit(True)
        yield from emit(False)

    return docs.select("text", "held_out").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _above(rows: DataFrame, most: int) -> int:
    """A count that at most `most` rows reach: the lowest step of a logarithmic scale of counts that fits.

    Only the scale's steps, a few hundred, come to the driver.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).alias("step")
    steps = rows.groupBy(step).agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("top")).collect()
    reached, least = 0, max((s["top"] for s in steps), default=0) + 1
    for s in sorted(steps, key=lambda s: -s["step"]):
        reached += s["rows"]
        if reached > most:
            break
        least = s["least"]
    return least


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x >= 0.5: Stirling's series at x + 8, and the recurrence back."""
    y = x + 8.0
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    # the product overflows for no count that a corpus can have (10^38 and more)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _nodes(depth: int, code: np.ndarray, bit: int) -> np.ndarray:
    """The node of each gram at a depth before the given bit: its context, and the bits of the symbol so far after a leading one."""
    context = (code >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return (context << np.uint64(8)) | np.uint64(1 << bit) | ((code & np.uint64(255)) >> np.uint64(8 - bit))


def _parents(depth: int, nodes: np.ndarray) -> np.ndarray:
    """Nodes one byte less deep: the earliest byte of the context goes."""
    return nodes & np.uint64((1 << 8 * depth) - 1)


def _mix(mine: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a node's own estimate, and its log weighted probability."""
    return 1 / (1 + np.exp(np.clip(split - mine, -700, 700))), np.logaddexp(mine, split) - math.log(2)


def crown(nodes: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the depths above `ROOT` give to a one, and the weight they leave, by the node of the last byte.

    nodes: those of the last byte, with the log weighted probability of all their children and their counts.
    """
    dense = [np.bincount(nodes, x, 1 << 16) for x in (below, zeros, ones)]
    below, zeros, ones = dense
    own, weighted = _mix(_log_estimate(zeros, ones), below)
    root = [x.reshape(256, 256).sum(0) for x in (weighted, zeros, ones)]
    root_own, _ = _mix(_log_estimate(root[1], root[2]), root[0])
    given, left = np.tile(root_own * (root[2] + 0.5) / (root[1] + root[2] + 1), 256), np.tile(1 - root_own, 256)
    return given + left * own * (ones + 0.5) / (zeros + ones + 1), left * (1 - own)


class Subtrees:
    """All nodes of depth `ROOT` and more that some grams have, from the grams' training counts."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        code, n = code[n > 0], n[n > 0].astype(np.float64)
        self.keys, self.zeros, self.ones, self.parents, self.own = {}, {}, {}, {}, {}
        one = np.concatenate([(code >> np.uint64(7 - b)) & np.uint64(1) for b in range(8)]).astype(np.float64)
        weight = np.tile(n, 8)
        for d in range(DEPTH, ROOT - 1, -1):
            keys, at = np.unique(np.concatenate([_nodes(d, code, b) for b in range(8)]), return_inverse=True)
            self.keys[d], self.zeros[d], self.ones[d] = keys, np.bincount(at, weight * (1 - one), len(keys)), np.bincount(at, weight * one, len(keys))
            mine = _log_estimate(self.zeros[d], self.ones[d])
            if d == DEPTH:
                self.own[d], self.weighted = np.ones(len(keys)), mine
            else:
                parent = self.parents[d + 1] = np.searchsorted(keys, _parents(d + 1, self.keys[d + 1]))
                self.own[d], self.weighted = _mix(mine, np.bincount(parent, self.weighted, len(keys)))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of the last byte with their children's log weighted probabilities and counts summed."""
        up = _parents(ROOT, self.keys[ROOT]).astype(np.int64)
        nodes, at = np.unique(up, return_inverse=True)
        return nodes, *(np.bincount(at, x, len(nodes)) for x in (self.weighted, self.zeros[ROOT], self.ones[ROOT]))

    def log10(self, code: np.ndarray, given: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after those before it; given, left: from `crown`."""
        one_at, rest = {}, {}
        for d in range(ROOT, DEPTH + 1):
            above, over = (given, left) if d == ROOT else (one_at[d - 1], rest[d - 1])
            parent = _parents(ROOT, self.keys[d]).astype(np.int64) if d == ROOT else self.parents[d]
            one_at[d] = above[parent] + over[parent] * self.own[d] * (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1)
            rest[d] = over[parent] * (1 - self.own[d])
        total = np.zeros(len(code))
        for b in range(8):
            top = _nodes(ROOT - 1, code, b).astype(np.int64)
            one = given[top] + 0.5 * left[top]
            for d in range(ROOT, DEPTH + 1):
                # where the path leaves the tree, deeper nodes have no counts and say one half
                node = _nodes(d, code, b)
                at = np.minimum(np.searchsorted(self.keys[d], node), max(0, len(self.keys[d]) - 1))
                hit = np.flatnonzero(self.keys[d][at] == node) if len(self.keys[d]) else np.empty(0, np.int64)
                one[hit] = one_at[d][at[hit]] + 0.5 * rest[d][at[hit]]
            total += np.log10(np.where((code >> np.uint64(7 - b)) & np.uint64(1), one, 1 - one))
        return total


def gram_logs(learned: DataFrame) -> DataFrame:
    """(key, n, log) of every distinct gram: -1 - its code, how often texts of both kinds have it, its log10 probability."""
    grams = learned.where("key < 0").select((F.lit(-1) - F.col("key")).alias("key"), "n")
    parts = 1 + grams.count() // PART_GRAMS
    spread = grams.repartition(max(parts, grams.sparkSession.sparkContext.defaultParallelism), F.shiftright("key", 9).bitwiseAND((1 << 8 * ROOT) - 1))

    def read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams with their counts in training texts and in all."""
        held = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        code, at = np.unique(key >> 1, return_inverse=True)
        return code.astype(np.uint64), np.bincount(at, n * (1 - (key & 1)), len(code)).astype(np.int64), np.bincount(at, n, len(code)).astype(np.int64)

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, _ = read(batches)
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in Subtrees(code, n).sums()], ["node", "below", "zeros", "ones"])

    sums = spread.mapInArrow(upward, "node long, below double, zeros double, ones double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("below", "zeros", "ones"))).toArrow()
    shared = grams.sparkSession.sparkContext.broadcast(crown(*(sums.column(c).to_numpy() for c in ("node", "below", "zeros", "ones"))))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, uses = read(batches)
        if len(code):
            logs = Subtrees(code, n).log10(code, *shared.value)
            for lo in range(0, len(code), 100_000):
                to = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - code[to].view(np.int64)), pa.array(uses[to]), pa.array(logs[to])], ["key", "n", "log"])

    return stored(spread.mapInArrow(downward, "key long, n long, log double"))


def score(docs: DataFrame, folds: int = FOLDS, head: int = HEAD, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_bits_per_byte."""
    source = texts(docs, (id_remainder(F.col("doc_id"), folds) == 0).alias("held_out"))
    learned = stored(counts(source))
    words = learned.where("key >= 0")
    trained = source.where(~F.col("held_out")).count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + trained, distinct + bool(trained)
    grams = gram_logs(learned)
    frequent, frequent_grams = _above(words, head), _above(grams, head_grams)
    kept, kept_grams = words.where(F.col("n") >= frequent).toArrow(), grams.where(F.col("n") >= frequent_grams).select("key", "log").toArrow()
    common = Table(kept.column("key").to_numpy(), np.log10(kept.column("n").to_numpy() + 0.1))
    common_grams = Table(-1 - kept_grams.column("key").to_numpy(), kept_grams.column("log").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((common_grams, common))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        common_grams, common = shared.value
        scores, sizes, n_words, n_known, logs, rare, times, n_rare = ([] for _ in range(8))
        for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
            code, _ = _grams(data, offsets)
            of_gram = np.repeat(np.arange(hi - lo), np.diff(offsets) + 1)
            slot = common_grams.find(code)
            hit = slot >= 0
            scores.append(np.bincount(of_gram[hit], common_grams.columns[0][slot[hit]], hi - lo))
            sizes.append(np.diff(offsets) + 1)
            key, first = _word_keys(data, offsets)
            text = np.repeat(np.arange(hi - lo), np.diff(first))
            slot = common.find(key)
            known = slot >= 0
            n_words.append(np.diff(first))
            n_known.append(np.bincount(text[known], minlength=hi - lo))
            logs.append(np.bincount(text[known], common.columns[0][slot[known]], hi - lo))
            text = np.concatenate([text[~known], of_gram[~hit]])
            key = np.concatenate([key[~known].view(np.int64), -1 - code[~hit].view(np.int64)])
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            rare.append(key[at])
            times.append(np.diff(np.append(at, len(key))))
            n_rare.append(np.bincount(text[at], minlength=hi - lo))
        join = np.concatenate
        struct = pa.StructArray.from_arrays([pa.array(join(rare)), pa.array(join(times).astype(np.int64))], ["key", "times"])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("held_out"), pa.array(join(n_words) + 1), pa.array(join(n_known).astype(np.int64)),
                pa.array(join(logs).astype(np.float64)), pa.array(join(scores).astype(np.float64)), pa.array(join(sizes).astype(np.int64)), lists(struct, join(n_rare)),
            ],
            ["doc_id", "held_out", "n_tokens", "known", "logs", "score", "n_bytes", "rare"],
        )

    rows = stored(
        source.mapInArrow(
            by_batch(run),
            "doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, n_bytes long, rare array<struct<key:long,times:long>>",
        ).withColumn("row", F.monotonically_increasing_id())
    )
    shared.unpersist()
    # words have keys from zero on, grams below
    looked_up = words.where(F.col("n") < frequent).select("key", F.log10(F.col("n") + F.lit(0.1)).alias("log")).unionByName(
        grams.where(F.col("n") < frequent_grams).select("key", "log")
    )
    word = F.col("key") >= 0
    seldom = (
        rows.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(looked_up, "key", "left")
        .groupBy("row").agg(
            F.sum(F.when(word & F.col("log").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
            F.sum(F.when(word, F.col("times") * F.coalesce("log", F.lit(-1.0))).otherwise(0.0)).alias("more_logs"),
            F.sum(F.when(~word, F.col("times") * F.col("log")).otherwise(0.0)).alias("more_score"),
        )
    )
    end_known, end_log = int(trained > 0), math.log10(trained + 0.1)
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(math.log10(total + 0.1 * (distinct + 1)))
    return rows.drop("rare").join(seldom, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0))).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(end_known)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("code_bits_per_byte"),
    )
