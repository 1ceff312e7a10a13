"""Rows and columns on which operators once failed."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from vitrine.llm import chosen_path, decontamination, harmonic_packing, media_columns, rlz_dedup, secret_ownership

#: Names that operators use or used for columns of their own.
NAMES = ["_id", "_mark", "_mark_of", "_own_id", "_own_mark", "_repeat", "_live", "row", "own_id", "own_mark", "hit_id", "hit_mark", "live", "others", "repeat", "key", "mark", "node"]


def prose(first, n=100):
    return " ".join(f"{first}{i}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, prose("x")), (2, prose("x")), (2, prose("y")), (3, "the password = hunter2hunter2"), (4, None), (5, "what is the answer to this"), (None, prose("z")), (3, "the password = hunter2hunter2")]
    rows = [(i, t, *(f"{name}{k}" for name in NAMES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in NAMES))


def test_rows_that_repeat_an_id_with_another_text(docs):
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in rlz_dedup.deduplicate(docs).collect() if r.n_words == 100)
    assert found == {(1, 100, 0): 1, (2, 100, 100): 1, (2, 100, 0): 1, (None, 100, 0): 1}


def test_all_columns_of_any_name_stay(docs, spark):
    given = {r for r in docs.collect()}
    items = spark.createDataFrame([("a", "the answer to this")], "item_id string, text string")
    cleaned = decontamination.clean(docs, items)
    assert cleaned.columns == docs.columns and given - set(cleaned.collect()) == {r for r in given if r.doc_id == 5}
    redacted = secret_ownership.redact(docs, secret_ownership.scan(docs, owner="doc_id"))
    assert redacted.columns == docs.columns
    assert {r for r in redacted.collect() if r.doc_id != 3} == {r for r in given if r.doc_id != 3}
    assert {r.text for r in redacted.collect() if r.doc_id == 3} == {"the [secret]"}
    single = chosen_path.one_of_each(docs)
    kept = single.collect()
    assert single.columns == docs.columns and set(kept) <= given
    assert Counter(r.doc_id for r in kept) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 1}
    assert [r._id for r in kept if r.doc_id == 3] == ["_id3"]  # the first by its other columns


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 700_000 + "b", "x" * 300_000, "\n" * 100_000 + "é" * 5])
def test_long_runs_are_packed(spark, text):
    pieces = harmonic_packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    exact, _ = harmonic_packing.encoders("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    n = len(exact.encode(text, add_special_tokens=False).ids) + 1
    assert sum(p.length for p in pieces) == n and {p.doc_tokens for p in pieces} == {n}


def test_images_without_pixels_and_of_false_sizes(spark):
    images = [b"P5 0 0 255\n", b"P5 3 0 255\n", b"P5 99999999999 99999999999 255\nx", b"P4 0 4\n", b"P2 2 2 0 1 1 1 1", b"P7 1 1 255 x", media_columns.encode_bmp(__import__("numpy").zeros((2, 2), "uint8"))[:60], b"P5 1 1 255\nx"]
    rows = [(i, data, "t", 5, 6, "p", "n") for i, data in enumerate(images)]
    given = spark.createDataFrame(rows, "name long, image binary, tiles string, height int, width int, payload_bytes string, tile string")
    kept = media_columns.store_images(given, "image")
    assert {r.name: r.height for r in kept.collect()} == {**dict.fromkeys(range(7)), 7: 1}
    found = {r.name: r.feature for r in media_columns.describe(kept, "image").collect()}
    assert {n for n, f in found.items() if f is not None} == {7}
    assert [(r.name, r.tile) for r in media_columns.tile_rows(kept, "image").collect()] == [(7, 0)]
