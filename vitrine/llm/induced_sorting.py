"""Suffix order of a shard by external induced sorting, with common prefixes carried along.

The suffixes that are smaller than their right neighbour's and follow a larger one (stars) are sorted first: the pieces
of text between stars are named in their order, and the names' string is sorted by the same procedure, recursively, until
the names of a level fit into memory and are sorted there. The order of stars induces that of all other suffixes: a scan in ascending order puts suffixes that are larger than their
right neighbour, a scan in descending order the rest.

A scan takes the next suffixes off a priority queue and pushes their left neighbours. What it carries are tuples (place,
suffix, common prefix with the neighbour in the order). A bucket's suffixes arrive in their order and the buckets'
sizes are counted beforehand, so an item's place is its key. The queue holds one page of places in memory; items of
later pages are kept as sorted runs, on disk beyond a limit, from which a page takes its slices when the scan reaches
it. All filled places up to the next gap are worked on as arrays.

The common prefix of two neighbours in a bucket is one more than the least one that the scan met between the suffixes
that pushed them; that of two stars is counted in names by the recursion and then in characters. The text, names,
counts and the queue live in memory up to a limit and beyond it in unlinked files in the folders that Spark names for
its own spills, which only the task itself reads: a lost executor loses nothing but the task's attempt.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np

#: Bytes of one scan's queue, of one array, and of the last level of the recursion that stay in memory.
MEMORY = 128 << 20
#: Bytes that the last level takes a name.
NAME_BYTES = 96
#: Items of a batch, and elements handled at a time elsewhere.
BATCH, PIECE = 1 << 15, 1 << 20
_FAR = np.iinfo(np.int32).max


class Space:
    """Arrays in memory, or in a file without a name if they exceed the limit."""

    def __init__(self, memory: int = MEMORY):
        self.memory = memory
        self.spilled = 0

    def file(self):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)

    def array(self, n: int, dtype, fill: int = 0) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.full(n, fill, dtype)
        self.spilled += n * np.dtype(dtype).itemsize
        with self.file() as file:
            out = np.memmap(file, dtype, "w+", shape=(n,))
        if fill:
            for at in range(0, n, PIECE):
                out[at : at + PIECE] = fill
        return out


class Queue:
    """Priority queue of (place, suffix, common prefix), scanned by place."""

    def __init__(self, places: int, space: Space):
        self.places, self.space = places, space
        self.index = np.int32 if places < 1 << 31 else np.int64
        self.size = max(16, min(max(places // 64, 1 << 14), space.memory // 32))
        self.edges = np.append(np.arange(0, places, self.size), places)
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.held, self.disk, self.stored, self.file = 0, [], 0, None
        self.at = self.lo = self.hi = 0
        self.suffix = self.near = np.empty(0, self.index)

    def push(self, place: np.ndarray, suffix: np.ndarray, near: np.ndarray) -> None:
        here = place < self.hi
        if n := np.count_nonzero(here):
            now = slice(None) if n == len(place) else here
            to = place[now] - self.lo
            self.suffix[to], self.near[to] = suffix[now], near[now]
            if n == len(place):
                return
            later = ~here
            place, suffix, near = place[later], suffix[later], near[later]
        self.fresh.append((place.astype(np.int64), suffix.astype(self.index), near.astype(np.int32)))
        self.held += len(place)
        if self.held * 16 > self.space.memory:
            self._spill()

    def _settle(self) -> None:
        """What was pushed since the last page becomes a sorted run."""
        if self.fresh:
            place, suffix, near = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
            order = np.argsort(place, kind="stable")
            self.runs.append((place[order], suffix[order], near[order]))
            self.fresh = []

    def _spill(self) -> None:
        self.fresh, self.runs = self.fresh + self.runs, []
        self._settle()
        place, suffix, near = self.runs.pop()
        if self.file is None:
            self.file = self.space.file()
        self.file.seek(self.stored)
        starts = []
        for x in (place, suffix, near):
            starts.append(self.stored)
            self.file.write(x.tobytes())
            self.stored += x.nbytes
        self.file.flush()
        self.space.spilled += place.nbytes + suffix.nbytes + near.nbytes
        self.disk.append((starts, np.searchsorted(place, self.edges)))
        self.held = 0

    def _read(self, start: int, dtype, lo: int, hi: int) -> np.ndarray:
        width = np.dtype(dtype).itemsize
        self.file.seek(start + lo * width)
        return np.frombuffer(self.file.read((hi - lo) * width), dtype)

    def _open(self) -> None:
        page = self.hi // self.size
        self.lo, self.hi = self.hi, min(self.hi + self.size, self.places)
        self.suffix, self.near = np.full(self.hi - self.lo, -1, self.index), np.zeros(self.hi - self.lo, np.int32)
        self._settle()
        rest = []
        for place, suffix, near in self.runs:
            cut = int(np.searchsorted(place, self.hi))
            self.suffix[place[:cut] - self.lo], self.near[place[:cut] - self.lo] = suffix[:cut], near[:cut]
            if cut < len(place):
                rest.append((place[cut:], suffix[cut:], near[cut:]))
        self.runs, self.held = rest, sum(len(x[0]) for x in rest)
        for starts, edges in self.disk:
            lo, hi = int(edges[page]), int(edges[page + 1])
            if lo < hi:
                to = self._read(starts[0], np.int64, lo, hi) - self.lo
                self.suffix[to], self.near[to] = self._read(starts[1], self.index, lo, hi), self._read(starts[2], np.int32, lo, hi)

    def take(self) -> tuple[int, np.ndarray, np.ndarray] | None:
        """The first place not yet taken, and suffixes and common prefixes of the filled places from there on."""
        if self.at == self.hi:
            if self.hi == self.places:
                return None
            self._open()
        first = end = self.at - self.lo
        step = 64
        while end < len(self.suffix) and end - first < BATCH:
            gap = self.suffix[end : end + step] < 0
            k = int(gap.argmax())
            if gap[k]:
                end += k
                break
            end += len(gap)
            step = min(step * 2, BATCH)
        if end == first:
            raise AssertionError("a scan reached a suffix that nothing induced")
        place, self.at = self.at, self.lo + end
        return place, self.suffix[first:end].copy(), self.near[first:end].copy()


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo[i] : hi[i] + 1]."""
    power = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    table = np.empty((int(power.max()) + 1, len(values)), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        half = 1 << k - 1
        table[k, : len(values) - half] = np.minimum(table[k - 1, :-half], table[k - 1, half:])
    return np.minimum(table[power, lo], table[power, hi - (1 << power) + 1])


class Minima:
    """The least common prefix that a scan met since the last push into each bucket."""

    def __init__(self, buckets: int, space: Space):
        self.last, self.rest = space.array(buckets, np.int32, -1), space.array(buckets, np.int32)
        self.batch = 0
        self.ends: list[int] = []
        self.least: list[int] = []

    def take(self, near: np.ndarray, at: np.ndarray, bucket: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of pushes by the batch's items `at`, ordered by bucket; `first` and `last` are each bucket's edges."""
        out = np.empty(len(at), np.int32)
        inner = np.ones(len(at), bool)
        inner[first] = False
        k = np.flatnonzero(inner)
        if len(k):
            out[k] = range_minima(near, at[k - 1] + 1, at[k])
        since = self.last[bucket[first]]
        place = np.searchsorted(self.ends, since, "right")
        between = np.array([*self.least, _FAR], np.int32)[place]
        found = np.minimum(np.minimum(self.rest[bucket[first]], between), np.minimum.accumulate(near)[at[first]])
        out[first] = np.where(since < 0, -1, found)
        after = np.append(np.minimum.accumulate(near[::-1])[::-1], np.int32(_FAR))
        self.last[bucket[last]], self.rest[bucket[last]] = self.batch, after[at[last] + 1]
        return out + np.int32(1)

    def close(self, near: np.ndarray) -> None:
        least = int(near.min())
        while self.least and self.least[-1] >= least:
            self.least.pop()
            self.ends.pop()
        self.least.append(least)
        self.ends.append(self.batch)
        self.batch += 1


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes, compared character by character."""
    out = np.zeros(len(a), np.int32)
    open_, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
    while len(open_):
        same = text[a] == text[b]
        open_, a, b = open_[same], a[same] + 1, b[same] + 1
        out[open_] += 1
    return out


def scan(text: np.ndarray, own: np.ndarray, other: np.ndarray, queue: Queue, space: Space, rising: bool, emit: Callable) -> None:
    """Induce suffixes of one kind (`own` a bucket, ahead of `other`) while going through the queue.

    emit(first place, suffixes, common prefixes, kinds, characters, ranks in the bucket, suffix before) gets each batch.
    """
    both = (own + other) if rising else (own + other)[::-1]
    start = np.cumsum(both) - both
    start = start if rising else start[::-1]
    free = start.copy()
    minima = Minima(len(own), space)
    before = -1
    while (batch := queue.take()) is not None:
        place, suffix, near = batch
        c = text[suffix]
        rank = np.arange(place, place + len(suffix)) - start[c]
        size = own[c]
        mine = rank < size
        edge = np.flatnonzero((rank == size) & (rank > 0))  # the two kinds meet inside a bucket
        if len(edge):
            near[edge] = common(text, suffix[edge], np.where(edge > 0, suffix[edge - 1], before))
        emit(place, suffix, near, mine, c, rank, before)
        at = np.flatnonzero(suffix > 0)
        left = text[suffix[at] - 1]
        ok = left > c[at] if rising else left < c[at]
        ok |= (left == c[at]) & mine[at]
        at, left = at[ok], left[ok]
        if len(at):
            order = np.argsort(left, kind="stable")
            at, left = at[order], left[order]
            new = np.ones(len(at), bool)
            new[1:] = left[1:] != left[:-1]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(at)))
            shared = minima.take(near, at, left, first, first + count - 1)
            to = np.repeat(free[left[first]] - first, count) + np.arange(len(at))
            free[left[first]] += count
            queue.push(to, suffix[at] - 1, shared)
        minima.close(near)
        before = int(suffix[-1])


def kinds(text: np.ndarray, letters: int, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stars in text order, and how many suffixes of each first letter are larger and smaller than their right neighbour."""
    n = len(text)
    larger, smaller = space.array(letters, np.int64), space.array(letters, np.int64)
    smaller[text[n - 1]] += 1
    found, carried, after = [], True, True
    for hi in range(n - 1, 0, -PIECE):
        lo = max(0, hi - PIECE)
        here, right = np.asarray(text[lo:hi]), np.asarray(text[lo + 1 : hi + 1])
        less, same = here < right, here == right
        nearest = np.where(same, hi, np.arange(lo, hi))
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        small = np.where(nearest < hi, less[np.minimum(nearest, hi - 1) - lo], carried)
        carried = bool(small[0])
        np.add(smaller, np.bincount(here[small], minlength=letters), out=smaller)
        np.add(larger, np.bincount(here[~small], minlength=letters), out=larger)
        ahead = np.append(small[1:], after)
        found.append(np.flatnonzero(ahead & ~small) + lo + 1)
        after = carried
    stars = space.array(sum(map(len, found)), np.int32 if n < 1 << 31 else np.int64)
    np.concatenate(found[::-1], out=stars) if found else None
    return stars, larger, smaller


def _chunk(text: np.ndarray, at: np.ndarray, length: np.ndarray, skip: int) -> np.ndarray:
    """The next letters of pieces as one number each; past a piece's end comes the largest value."""
    letters, bits = (8, 8) if text.dtype == np.uint8 else (2, 32)
    out, pad = np.zeros(len(at), np.uint64), np.uint64((1 << bits) - 1)
    for d in range(skip, skip + letters):
        letter = text[np.minimum(at + d, len(text) - 1)].astype(np.uint64)
        out = out << np.uint64(bits) | np.where(d < length, letter, pad)
    return out


def named(text: np.ndarray, stars: np.ndarray, space: Space) -> tuple[np.ndarray, int]:
    """Rank of each piece from a star to the next one, both included, and the number of different pieces.

    No piece is a proper beginning of a larger one: where one ends the other goes on with a suffix of the other kind,
    which makes it smaller, so the value past the end is the largest. Pieces are sorted in parts that fit into memory.
    """
    n = len(stars)
    step = 8 if text.dtype == np.uint8 else 2
    names, keys = space.array(n, np.int32 if n < 1 << 31 else np.int64), space.array(n, np.uint64)
    lengths = lambda lo, hi: np.append(stars[lo + 1 : hi + 1], [stars[-1]] * (hi == n)).astype(np.int64) - stars[lo:hi] + 1
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        keys[lo:hi] = _chunk(text, stars[lo:hi].astype(np.int64), lengths(lo, hi), 0)
    parts = -(-n * 64 // max(space.memory, 1 << 12))
    sample = np.sort(keys[:: max(1, n // (parts * 64))])
    cuts = np.unique(sample[np.arange(1, parts) * len(sample) // parts]) if parts > 1 else sample[:0]
    distinct = 0
    for part in range(len(cuts) + 1):
        inside = []
        for lo in range(0, n, PIECE):
            of = np.searchsorted(cuts, keys[lo : lo + PIECE], "right") == part
            inside.append(np.flatnonzero(of) + lo)
        own = np.concatenate(inside)
        if not len(own):
            continue
        at = stars[own].astype(np.int64)
        length = stars[np.minimum(own + 1, n - 1)].astype(np.int64) - at + 1
        rank, skip = _groups(np.zeros(len(own), np.int64), keys[own]), step
        while (more := length > skip).any():
            again = np.zeros(len(own), bool)
            again[rank[more]] = True  # a rank is the number of pieces in smaller groups
            sub = np.flatnonzero(again[rank])
            rank[sub] = _groups(rank[sub], _chunk(text, at[sub], length[sub], skip))
            skip += step
        values, dense = np.unique(rank, return_inverse=True)
        names[own] = dense + distinct
        distinct += len(values)
    return names, distinct


def _groups(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks refined by a further key; a rank grows by the members of its group with smaller keys."""
    order = np.lexsort((key, rank))
    r, k = rank[order], key[order]
    at = np.arange(len(r))
    first = np.ones(len(r), bool)
    first[1:] = r[1:] != r[:-1]
    new = first.copy()
    new[1:] |= k[1:] != k[:-1]
    group, start = np.maximum.accumulate(np.where(first, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(len(r), np.int64)
    out[order] = r + start - group
    return out


def in_memory(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a string of names in ascending order and the common prefix of each with the one before, by doubling.

    Round k knows the rank of the first 2^k names of each suffix; only groups that are not yet told apart are sorted.
    The ranks of all rounds are kept, and two neighbours' common prefix is read off them from the last round down.
    """
    n = len(names)
    rank = _groups(np.zeros(n, np.int64), names.astype(np.int64)).astype(np.int32)
    rounds, active, width = [rank.copy()], np.arange(n), 1
    while True:
        own = rank[active]
        active = active[np.bincount(own, minlength=1)[own] > 1]
        if not len(active):
            break
        key = rank[active].astype(np.int64) << 32 | rank[active + width]
        order = np.argsort(key)
        key, active = key[order], active[order]
        at, head = np.arange(len(key)), key >> 32
        first, new = np.ones(len(key), bool), np.ones(len(key), bool)
        first[1:], new[1:] = head[1:] != head[:-1], key[1:] != key[:-1]
        rank[active] = head + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        rounds.append(rank.copy())
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    near, a, b = np.zeros(n, np.int32), order[:-1].copy(), order[1:].copy()
    for k in range(len(rounds) - 1, -1, -1):
        same = (rounds[k][a] == rounds[k][b]).astype(np.int64) << k
        a += same
        b += same
        near[1:] += same.astype(np.int32)
    return order, near


def suffix_order(text: np.ndarray, letters: int, space: Space, emit: Callable) -> None:
    """Suffixes of the text in descending order: emit(batch of suffixes, common prefix of each with the larger neighbour, that neighbour of the first).

    Letters are below `letters`; the last one is the smallest and occurs nowhere else.
    """
    n = len(text)
    stars, larger, smaller = kinds(text, letters, space)
    names, distinct = named(text, stars, space)
    m = len(stars)
    order, near = space.array(m, stars.dtype), space.array(m, np.int32)
    if distinct == m:
        order[names] = np.arange(m, dtype=order.dtype)
    elif m * NAME_BYTES <= space.memory:
        order[:], near[:] = in_memory(names)
    else:
        top = m

        def collect(suffix: np.ndarray, shared: np.ndarray, before: int) -> None:
            nonlocal top
            order[top - len(suffix) : top] = suffix[::-1]
            inner = shared if top < m else shared[1:]
            near[top - len(suffix) + 1 : top - len(suffix) + 1 + len(inner)] = inner[::-1]
            top -= len(suffix)

        suffix_order(names, distinct, space, collect)
    del names

    counts = space.array(letters, np.int64)
    ahead = Queue(int(larger.sum()) + m, space)
    up_to = np.cumsum(larger)
    for lo in range(0, m, PIECE):
        hi = min(m, lo + PIECE)
        ranked = order[lo:hi].astype(np.int64)
        here, shared = stars[ranked], near[lo:hi].astype(np.int64)
        prefix = np.zeros(hi - lo, np.int64)
        right = ranked[lo == 0 :]  # the first star has no smaller neighbour
        left, shared = order[lo + (lo == 0) - 1 : hi - 1].astype(np.int64), shared[lo == 0 :]
        # the names both have in common, then the first piece that differs
        prefix[lo == 0 :] = stars[left + shared].astype(np.int64) - stars[left] + common(text, stars[left + shared], stars[right + shared])
        first = text[here]
        counts += np.bincount(first, minlength=letters)
        ahead.push(np.arange(lo, hi) + up_to[first], here, np.minimum(prefix, _FAR - 1))
    del order, near

    back = Queue(n, space)
    whole = np.cumsum(larger + smaller) - (larger + smaller)
    held: list[np.ndarray] = []

    def hand_over(place, suffix, near, mine, c, rank, before) -> None:
        """Larger suffixes go to the second queue, each with its common prefix with the next one of the bucket."""
        nonlocal held
        to, own, shared, first = whole[c[mine]] + rank[mine], suffix[mine], near[mine], rank[mine] == 0
        if held:
            to, own, shared, first = (np.concatenate(x) for x in zip(held, (to, own, shared, first), strict=True))
        if len(to):
            back.push(n - 1 - to[:-1], own[:-1], np.where(first[1:], 0, shared[1:]))
            held = [x[-1:] for x in (to, own, shared, first)]

    scan(text, larger, counts, ahead, space, True, hand_over)
    if held:
        back.push(n - 1 - held[0], held[1], np.zeros(1, np.int32))
    back.push(np.array([n - 1]), np.array([n - 1]), np.zeros(1, np.int32))
    scan(text, smaller, larger, back, space, False, lambda place, suffix, near, mine, c, rank, before: emit(suffix, near, before))


def repeated(text: np.ndarray, letters: int, length: int, space: Space) -> np.ndarray:
    """Flags of the places where a string of `length` letters starts that also starts elsewhere."""
    out = space.array(len(text), bool)

    def mark(suffix: np.ndarray, near: np.ndarray, before: int) -> None:
        at = np.flatnonzero(near >= length)
        out[suffix[at]] = True
        out[np.where(at > 0, suffix[at - 1], before)] = True

    suffix_order(text, letters, space, mark)
    return out
