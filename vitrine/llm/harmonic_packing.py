"""Sequence packing by harmonic classes.

A document's ids (its tokens and one end id) are cut into pieces of the capacity and, for the rest, into falling powers
of two. A piece of length n belongs to the class k = capacity // n of reciprocal capacities, and a bin of class k takes
exactly k pieces, so with these cuts every bin of every class is full. Each worker fills its own bins from the rows of
its partition; nothing is shuffled. What a worker has left in a class at its end, fewer than k pieces, is split by the
binary digits of its number into sequences whose fill is a power of two, which need no padding.

A sequence's id is the partition's number times 2^40 plus a running number, so a repeated task gives the same ids. A
null or empty text is its end id alone. Each repeated row is packed as a document of its own. Memory: one batch, and
less than k open pieces a class.

Ids are those of the `tokenizers` file. Where a text has only characters on which both libraries cut
alike, the same vocabulary is applied by `tiktoken`, which is several times faster (tests compare them); other
texts, and those with a very long run of blanks or of other characters, go to `tokenizers` itself. Special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vitrine.llm.common import texts

CAPACITY = 2048
END_ID = 1
#: Anything but characters of Latin blocks and common controls.
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x84\x86-ɏ]")
#: Runs on which the fast form's pattern would nest too deeply.
_LONG_RUN = re.compile(r"\s{4096}|\S{65536}")


@functools.cache
def encoders(vocabulary: str, ranks: str):
    """The tokenizer of the file, and the fast form of the same vocabulary."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    exact.encode_special_tokens = True
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return exact, fast


def token_ids(text: str, vocabulary: str, ranks: str) -> np.ndarray:
    exact, fast = encoders(vocabulary, ranks)
    if _UNUSUAL.search(text) or _LONG_RUN.search(text):
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(fast.encode_ordinary(text), "<u4")


def cuts(n: int, capacity: int) -> np.ndarray:
    """Lengths of a document's pieces: whole capacities, then the binary digits of the rest."""
    rest = n % capacity
    return np.array([capacity] * (n // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


class Bins:
    """Open bins of one worker."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[pa.RecordBatch]] = {}

    def _placed(self, pieces: pa.Table, length: int, per_bin: int) -> pa.RecordBatch:
        n = pieces.num_rows
        sequence = self.next + np.arange(n) // per_bin
        self.next += n // per_bin
        pieces = pieces.combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays(
            [*pieces.columns, pa.array(sequence, pa.int64()), pa.array(np.arange(n) % per_bin * length, pa.int64())], [*_COLUMNS, "sequence_id", "offset"]
        )

    def add(self, length: int, pieces: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Take pieces of one length; give what fills bins."""
        per_bin = self.capacity // length
        table = pa.Table.from_batches([*self.open.pop(length, []), pieces])
        full = table.num_rows // per_bin * per_bin
        if full:
            yield self._placed(table.slice(0, full), length, per_bin)
        if full < table.num_rows:
            self.open[length] = table.slice(full).combine_chunks().to_batches()

    def close(self) -> Iterator[pa.RecordBatch]:
        """Place what is left in sequences filled to powers of two."""
        for length in sorted(self.open, reverse=True):
            table, at = pa.Table.from_batches(self.open[length]), 0
            while at < table.num_rows:
                take = 1 << (table.num_rows - at).bit_length() - 1
                yield self._placed(table.slice(at, take), length, take)
                at += take
        self.open = {}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `capacity` is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            column = batch.column("text")
            for row in range(batch.num_rows):
                ids = np.append(token_ids(column[row].as_py(), vocabulary, ranks), np.array([end_id], "<u4"))
                view, at = memoryview(ids.tobytes()), 0
                sizes = cuts(len(ids), capacity).tolist()
                for size in sizes:
                    starts.append(at)
                    crcs.append(zlib.crc32(view[4 * at : 4 * (at + size)]))
                    at += size
                lengths += sizes
                rows += [row] * len(sizes)
                totals += [len(ids)] * len(sizes)
            size = np.array(lengths, np.int64)
            order = np.argsort(-size, kind="stable")
            pieces = pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(np.array(rows, np.int64)[order]))]
                + [pa.array(np.array(x, np.int64)[order]) for x in (starts, lengths, crcs, totals)],
                _COLUMNS,
            )
            size = size[order]
            edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    yield from bins.add(int(size[lo]), pieces.slice(lo, hi - lo))
        yield from bins.close()

    return texts(docs).mapInArrow(
        work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
