"""Fill-in-the-middle transformation by in-place block rotation.

A text is cut into lines; two cuts drawn from a hash of the id part it into prefix, middle and suffix. The text's bytes
lie in one bytearray: the cuts are found by scanning for line ends, sentinels are inserted before each part, and
segments change places by rotation, which is three reversals in place. Forms:

* psm: `<P>`prefix`<S>`suffix`<M>`middle, from `<P>`prefix`<M>`middle`<S>`suffix by rotating what follows the prefix;
* spm: `<S>`suffix`<P>`prefix`<M>`middle, by rotating the whole;
* plain: the text itself, where it is empty, holds a sentinel, or the rate leaves it out.

`restore` finds the sentinels in an output, rotates back and takes them out; as a text with a sentinel stays plain, no
other place can match, not even across a cut.

Each row is worked on alone, in one pass and without a shuffle; a reversal moves `CHUNK` bytes at a time, so memory is
the batch and a text. Null text: empty, hence plain. A null id hashes as the empty decimal. Repeated rows each give a
row; ties do not occur; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import by_batch, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
#: Of a hundred texts, how many are transformed, and how many of these take the form spm.
RATE, SPM = 100, 50
#: Bytes exchanged at a time by a reversal.
CHUNK = 1 << 16


def reverse(buffer: bytearray, lo: int, hi: int) -> None:
    """Reverse buffer[lo:hi] in place, ends first."""
    while hi - lo > 1:
        step = min(CHUNK, (hi - lo) // 2)
        head = buffer[lo : lo + step]
        head.reverse()
        tail = buffer[hi - step : hi]
        tail.reverse()
        buffer[lo : lo + step], buffer[hi - step : hi] = tail, head
        lo, hi = lo + step, hi - step


def rotate(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbouring segments buffer[lo:mid] and buffer[mid:hi] in place by three reversals."""
    if lo < mid < hi:
        reverse(buffer, lo, mid)
        reverse(buffer, mid, hi)
        reverse(buffer, lo, hi)


def line_ends(data: bytes | bytearray, first: int, second: int) -> tuple[int, int]:
    """Bytes in the first `first` and the first `second` lines; first <= second, and there are that many lines."""
    at, out = 0, []
    for lines in (first, second - first):
        for _ in range(lines):
            at = data.find(b"\n", at) + 1 or len(data)
        out.append(at)
    return out[0], out[1]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight digits of the digest."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def characters(data: bytes | bytearray) -> int:
    return len(data.decode())


def transformed(data: bytes, drawn: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, characters of prefix and of middle, and output of one text."""
    n = data.count(b"\n") + (not data.endswith(b"\n") and data != b"")
    if not data or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)) or drawn[2] % 100 >= rate:
        return n, "plain", None, None, data
    low, high = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = line_ends(data, low, high)
    prefix_chars, middle_chars = characters(data[:a]), characters(data[a:b])
    buffer = bytearray(data)
    for at, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    a, b = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    if drawn[3] % 100 < spm:
        rotate(buffer, 0, b, len(buffer))
        return n, "spm", prefix_chars, middle_chars, bytes(buffer)
    rotate(buffer, a, b, len(buffer))
    return n, "psm", prefix_chars, middle_chars, bytes(buffer)


def restored(data: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return data
    buffer = bytearray(data)
    if form == "psm":
        suffix, middle = buffer.index(SUFFIX), buffer.index(MIDDLE)
        rotate(buffer, suffix, middle, len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _forward(seed: int, rate: int, spm: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, column = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
        made = [transformed(text.as_py(), draws(i, seed), rate, spm) for i, text in zip(ids, column, strict=True)]
        n, form, prefix, middle, output = zip(*made, strict=True)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, k) for x, k in zip((n, form, prefix, middle), kinds, strict=True)), pa.array(output, pa.binary()).cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (null where plain), output."""
    return texts(docs).mapInArrow(by_batch(_forward(seed, rate, spm)), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, into: str = "restored") -> DataFrame:
    """The rows of `transform` with the text rebuilt from output and form alone; further columns stay.

    A null output or form gives a null text.
    """
    place = [rows.columns.index(c) for c in ("output", "form")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        outputs, forms = (batch.column(i) for i in place)
        made = [None if o is None or f is None else restored(o, f) for o, f in zip(outputs.cast(pa.binary()).to_pylist(), forms.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()).cast(pa.string())], [*batch.schema.names, into])

    schema = rows.select("*", F.lit(None).cast("string").alias(into)).schema
    return rows.mapInArrow(by_batch(run), schema)
