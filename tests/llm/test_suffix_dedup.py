"""Suffix orders against a naive one, and byte deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vitrine.llm import induced_sorting, queries, suffix_dedup
from vitrine.llm.common import table

SCHEMA = "doc_id long, text string, key string, copies long, blocks string, start int, anchor long"


def naive_order(letters):
    order = sorted(range(len(letters)), key=lambda i: letters[i:])
    shared = []
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(letters) and letters[a + k] == letters[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("memory", [64, 400, 1 << 20])
@pytest.mark.parametrize("batch", [2, 7, 1 << 15])
def test_suffix_order(monkeypatch, memory, batch):
    monkeypatch.setattr(induced_sorting, "BATCH", batch)
    rng = random.Random(memory + batch)
    for trial in range(120):
        monkeypatch.setattr(induced_sorting, "PIECE", rng.choice([3, 10, 1 << 20]))
        size = rng.choice([1, 2, 3, 8, 200])
        letters = [rng.randrange(2, 2 + size) for _ in range(rng.randrange(1, 60))] * rng.choice([1, 1, 3])
        if trial % 3 == 0:
            letters += [5] * rng.randrange(30) + letters
        text = np.array([*letters, 0], rng.choice([np.uint8, np.int32]))
        got, near = [], []
        induced_sorting.suffix_order(text, int(text.max()) + 1, induced_sorting.Space(memory), lambda s, n, before: (got.extend(s.tolist()), near.extend(n.tolist())))
        order, shared = naive_order(text.tolist())
        assert got[::-1] == order and near[1:][::-1] == shared


def test_shard_larger_than_memory():
    """The order is the same where nearly everything lies on disk."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    data = " ".join(rng.choice(words) for _ in range(30_000)).encode()
    text = np.append(np.frombuffer(data + data[5000:25_000], np.uint8) + 2, 0).astype(np.uint8)
    small, large = induced_sorting.Space(1 << 14), induced_sorting.Space(1 << 30)
    orders = []
    for space in (small, large):
        found = []
        induced_sorting.suffix_order(text, 256, space, lambda s, n, before, found=found: found.append((s, n)))
        orders.append([np.concatenate(x) for x in zip(*found, strict=True)])
    assert all(np.array_equal(a, b) for a, b in zip(*orders, strict=True))
    assert small.spilled > 20 * len(text) and large.spilled == 0
    keys = [bytes(text[i:]) for i in orders[0][0][:: 997]]
    assert keys == sorted(keys, reverse=True)


def plain(rows, window):
    """doc_id, bytes, removed, spans, digest of what is kept of each row."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + window] for _, d in data for k in range(len(d) - window + 1))
    out = Counter()
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def awkward():
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abc é\n你") for _ in range(n))
    base, passage, line = prose(900), prose(60), prose(25)
    rows = [(1, base), (1, base), (2, base), (2, prose(300)), (None, None), (None, passage), (3, None), (4, ""), (5, "x" * 500), (6, "ab" * 300), (7, passage), (8, base[:400] + "Q" + base[401:])]
    rows += [(20 + i, prose(rng.randrange(40)) + passage + prose(rng.randrange(40))) for i in range(40)]
    rows += [(70 + i, line + prose(30)) for i in range(30)] + [(100, prose(4000) + passage + prose(500) + passage), (100, prose(50))]
    return [(*r, "k", 1, "b", 3, 4) for r in rows]


@pytest.mark.parametrize(("window", "anchor", "hot"), [(40, 12, 1 << 30), (40, 12, 900), (40, 3, 200), (9, 9, 0), (400, 128, 1 << 30)])
def test_brute_force(spark, window, anchor, hot):
    rows = awkward()
    made = suffix_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3), window, anchor, 4000, hot, 1 << 13).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in made) == plain([r[:2] for r in rows], window)
    assert all(sum(s.byte_end - s.byte_start for s in r.spans) == r.n_removed for r in made)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    made = suffix_dedup.deduplicate(docs).collect()
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], suffix_dedup.WINDOW)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in made) == want
    assert sum(r.n_removed for r in made)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op13_suffix_dedup"](spark, str(tmp_path)).count() == 0
