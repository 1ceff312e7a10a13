"""Operators against brute force on small inputs with deliberately hot keys."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from vitrine.functions import predicates
from vitrine.operators import attribution, blocks, completion, experiments, fusion, lexical, quota, running, sessions, tiers, triggers, vector
from vitrine.plans import search
from vitrine.sources import bind
from vitrine.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_running_totals_in_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i, i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, pos long, value long")
    out = running.with_running(
        df, ["key"], F.floor(F.col("pos") / 50), ["pos"], sums={"total": F.col("value")},
        lasts={"last_even": (F.col("value") % 2 == 0, F.col("pos"))},
    )
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select(
        "*", F.sum("value").over(w).alias("total"),
        F.last(F.when(F.col("value") % 2 == 0, F.col("pos")), ignorenulls=True).over(w).alias("last_even"),
    )
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def anchored(times, limit, window):
    out, start, count = [], None, 0
    for t in times:
        if start is None or t >= start + window:
            start, count = t, 0
        count += 1
        out.append((t, start, count, count <= limit))
    return out


def test_quota_agrees_with_a_loop(spark):
    rng = random.Random(3)
    hits, expected = [], {}
    for key, n in (("hot", 400), ("steady", 3000), ("a", 9), ("b", 1)):
        times = sorted(rng.sample(range(0, 4000), n))
        expected[key] = anchored([t * 1_000_000 for t in times], 3, 60 * 1_000_000)
        hits += [(key, i, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(hits, "key string, hit_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows = quota.consumed(df, 3, 60).orderBy("key", "hit_id").collect()
    for key, want in expected.items():
        got = [(int(r["ts"].timestamp() * 1_000_000), r["opened"], r["count"], r["allowed"]) for r in rows if r["key"] == key]
        assert got == want


def test_blocked_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    items = [("big" if i % 4 else "small", f"i{i}", rng.standard_normal(8).tolist()) for i in range(300)]
    queries = [(lane, f"q{j}", rng.standard_normal(8).tolist()) for j in range(20) for lane in ("big", "small")]
    q = spark.createDataFrame(queries, "lane string, qid string, vector array<double>")
    i = spark.createDataFrame(items, "lane string, id string, vector array<double>")
    got = blocks.blocked_top_k(q, i, vector.cosine_cell, 5, query_rows=7, item_rows=40).collect()
    mine = {(r["lane"], r["qid"], r["rank"]): r["id"] for r in got}
    for lane, qid, v in queries:
        scored = sorted((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6), name) for l, name, x in items if l == lane)
        assert [mine[(lane, qid, n)] for n in range(5)] == [name for _, name in scored[:5]]


def test_a_cell_without_items(spark):
    """More blocks than items: some cells hold queries alone."""
    q = spark.createDataFrame([("l", f"q{j}", [1.0, float(j)]) for j in range(9)], "lane string, qid string, vector array<double>")
    i = spark.createDataFrame([("l", f"i{j}", [1.0, float(-j)]) for j in range(4)], "lane string, id string, vector array<double>")
    got = blocks.blocked_top_k(q, i, vector.cosine_cell, 2, query_rows=2, item_rows=1).collect()
    assert len(got) == 18


def test_fusion_scores_and_tie_order(spark):
    hit = "lane string, qid string, id string, score double, rank int"
    text = spark.createDataFrame([("l", "q", "a", 2.0, 0), ("l", "q", "b", 1.0, 61)], hit)
    vec = spark.createDataFrame([("l", "q", "a", 2.0, 0), ("l", "q", "c", 2.0, 0)], hit)
    rows = fusion.fuse(text, vec).orderBy(*fusion.fused_order()).collect()
    assert [r["id"] for r in rows] == ["a", "b", "c"]
    assert rows[0]["rrf"] == pytest.approx(2 / 61 + 1 / 61)


def test_source_merge_boosts(spark):
    row = "lane string, qid string, tenant string, id string"
    soft = spark.createDataFrame([("l", "q", "t", "both"), ("l", "q", "t", "soft")], row)
    similar = spark.createDataFrame([("l", "q", "t", "both"), ("l", "q", "t", "near")], row)
    got = {r["id"]: r["similarity_boost"] for r in tiers.merge_sources(soft, similar).collect()}
    assert got == {"both": 5000, "near": 2500, "soft": 0}


def test_pages_are_disjoint_and_complete(spark):
    ranked = spark.range(70).select(F.lit("q").alias("qid"), F.col("id").cast("string").alias("id"), F.col("id").alias("rank"))
    pages = fusion.with_page_state(fusion.paged(ranked), ["qid"]).collect()
    assert len({r["id"] for r in pages}) == len(pages) == 65
    assert {r["batch"] for r in pages} == {1, 2, 3, 4}
    assert [r["has_more"] for r in sorted(pages, key=lambda r: r["rank"])][-1] is False


def test_alias_chains_and_cycles(spark):
    edges = [(f"s{i}", f"s{i + 1}") for i in range(20)] + [("x", "y"), ("y", "z"), ("z", "x"), ("tail", "x")]
    df = spark.createDataFrame(edges, "old_session_id string, new_session_id string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")
    )
    got = {r["old_session_id"]: r["session_id"] for r in sessions.canonical_ids(sessions.alias_edges(df)).collect()}
    assert all(got[f"s{i}"] == "s20" for i in range(20))
    assert {got[k] for k in ("x", "y", "z", "tail")} == {"x"}


def test_filter_cleanup_cases(spark):
    rows = [([], "wine"), (["", " ", None], "wine"), (["יין", "", None, "וודקה"], "wine"), (None, None), (None, ""), (["יין אדום"], "wine")]
    df = spark.createDataFrame(rows, "category array<string>, type string")
    got = [(r["category"], r["type"]) for r in fusion.clean_filters(df, ["category"], ["type"]).collect()]
    assert got == [(None, "wine"), (None, "wine"), (["יין", "וודקה"], "wine"), (None, None), (None, None), (["יין אדום"], "wine")]


def test_tier_membership_scenarios(spark):
    rows = [("d", ["a"], ["d"]), ("a", ["a"], ["d"]), ("a", ["a"], ["a"]), ("d", ["a"], None)]
    df = spark.createDataFrame(rows, "product_id string, search_results array<string>, tier2_results array<string>")
    got = [(r["in_tier1"], r["tier2_product"], r["tier2_upsell"]) for r in attribution.with_tiers(df).collect()]
    assert got == [(False, True, True), (True, False, False), (True, True, False), (False, None, None)]


def test_order_webhook(spark):
    body = {
        "id": 1, "name": "#1234", "created_at": "2026-01-10T12:34:56Z", "currency": "ILS", "total_price": "450.00",
        "line_items": [{"product_id": 5, "quantity": 2, "price": "150.00"}, {"product_id": 6, "quantity": 1, "price": "oops"}],
        "note_attributes": [{"name": "other", "value": "x"}, {"name": "session_id", "value": "sess-1-abc"}],
    }
    orders = attribution.parse_orders(spark.createDataFrame([(json.dumps(body),)], "body string"))
    row = orders.first()
    assert (row["session_id"], str(row["total_price"]), len(row["line_items"])) == ("sess-1-abc", "450.00", 2)
    assert [str(r["price"]) for r in attribution.order_lines(orders).collect()] == ["150.00", "None"]


def test_trigger_reasons(spark):
    product = {"id": "1", "name": "red wine", "stockStatus": "instock"}
    payloads = [
        ({"products": []}, "no_results"), ([dict(product, stockStatus="outofstock")], "out_of_stock"),
        ([product], None), ({"results": [dict(product, name="beer")]}, "non_literal"),
        ({"products": [product], "metadata": {"isComplex": True}}, "non_literal"),
        ({"products": [dict(product, name="beer", highTextMatch=True)]}, None),
        ({"products": [product], "metadata": {"tiers": {"highTextMatches": 0}}}, "non_literal"),
    ]
    rows = [(i, "t", "red wine", json.dumps(p)) for i, (p, _) in enumerate(payloads)] + [(99, "t", "red wine", '{"other": 1}'), (98, "t", "r", "[]")]
    df = spark.createDataFrame(rows, "query_id int, tenant string, query string, payload string")
    got = {r["query_id"]: r["reason"] for r in triggers.decisions(triggers.parsed(df)).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(payloads)}


def test_streams_over_several_batches_equal_batch(spark, tmp_path):
    from vitrine.operators import chat

    source = bind.feedback(spark, SF)
    source.repartition(3).write.parquet(str(tmp_path / "feedback"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feedback"))
    table = jobs.latest(jobs.to_table(jobs.feedback_counts(stream), "f", "update", str(tmp_path / "out")), ["conversation_id"])
    batch = chat.engagement(source).drop("first_at")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, batch.collect()))

    writes = bind.conversation_writes(spark, SF)
    writes.repartition(4).write.parquet(str(tmp_path / "writes"))
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "writes"))
    merged = jobs.upserted_conversations(stream, str(tmp_path / "conversations"))
    want = sorted(map(str, chat.latest_conversations(writes).select(*merged.columns).collect()))
    assert sorted(map(str, merged.collect())) == want
    again = jobs.upserted_conversations(stream, str(tmp_path / "conversations"))
    assert sorted(map(str, again.collect())) == want


def test_postings_count_inside_rows_and_merge_repeated_products(spark, tmp_path, capsys):
    import collections
    import re

    def product(number, tenant, text, name="Red red ROSE"):
        return (tenant, str(number), name, ["Fresh cut"], ["red", None, "rose-red"], text)

    schema = "tenant string, id string, name string, category array<string>, soft_category array<string>, description string"
    rows = [product(1, "a", "b a b, B c"), product(2, "a", None, name=None), product(3, "b", " .. "), product(None, "a", "x y"), product(5, "a", "ß x ß")]
    products = spark.createDataFrame(rows, schema)
    lexical.postings(products).explain()
    assert "Exchange" not in capsys.readouterr().out  # counted without a shuffle of all words

    again = [*rows, product(1, "a", "a b c d e"), product(None, "a", "x z"), product(1, "b", "a")]
    for given in (rows, again):
        want = collections.Counter()
        for tenant, number, name, category, soft, text in given:
            listed = {"name": name, "category": " ".join(category), "soft_category": " ".join(w for w in soft if w), "description": text}
            for field, value in listed.items():
                words = [w for w in re.split(r"[^a-zß]+", (value or "").lower()) if w]
                for word in words:
                    want[tenant, field, word, number, len(words)] += 1
        want = sorted(((*key[:4], n, key[4]) for key, n in want.items()), key=str)
        products = spark.createDataFrame(given, schema)
        assert sorted(map(tuple, lexical.postings(products).collect()), key=str) == want
        kept = lexical.stored_index(products, str(tmp_path / str(len(given))))
        assert sorted(map(tuple, kept.postings.collect()), key=str) == want


def test_a_table_in_parts_is_streamed_like_one_file(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as conv_id", "id % 3 as turn", "'user' as role", "concat('t', id) as text")
    for name, parts in (("whole", 1), ("parts", 4)):
        rows.repartition(parts).write.parquet(str(tmp_path / name / "conversations.parquet"))
    (part,) = (tmp_path / "whole" / "conversations.parquet").glob("part-*")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "conversations.parquet").symlink_to(part)
    (tmp_path / "one" / "more_conversations.parquet").symlink_to(part)  # another table
    for name in ("one", "whole", "parts"):
        stream = jobs.read_table(spark, str(tmp_path / name), "conversations")
        table = jobs.to_table(stream, "copy", folder=str(tmp_path / f"out-{name}"))
        assert sorted(map(tuple, table.drop("batch_number").collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("per_batch", [8, 2])
def test_quota_stream_over_files_and_batches_equals_batch(spark, tmp_path, per_batch):
    """Files in one batch come in any order; batches follow the time."""
    rng = random.Random(5)
    times = sorted(rng.sample(range(0, 40_000), 400))
    for part in range(4):
        block = [("hot" if i % 3 else "other", i, times[i]) for i in range(part * 100, part * 100 + 100)]
        rng.shuffle(block)
        df = spark.createDataFrame(block, "key string, hit_id long, s long").select("key", "hit_id", F.timestamp_seconds("s").alias("ts"))
        df.repartition(2).write.mode("append").parquet(str(tmp_path / "hits"))
    source = spark.read.parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "hits"))
    table = jobs.to_table(jobs.consumed_quota(stream, 3, 600, "1 hour"), "quota", folder=str(tmp_path / "out"), state_store=jobs.ROCKSDB)
    fields = ["key", "hit_id", "opened", "count", "allowed"]
    batch = quota.consumed(source, 3, 600).select(*fields)
    assert sorted(map(tuple, table.select(*fields).collect())) == sorted(map(tuple, batch.collect()))
    assert table.select("batch_number").distinct().count() >= 8 // per_batch


def test_second_tier_finds_products_outside_the_pool(spark):
    """The pool is full of better matches; only a search among the wanted categories reaches the last product."""
    rows = [("s0", "seed", "red ring", ["shelf"], ["wanted"]), ("s0", "zzz", "ring of the last page", ["shelf"], ["wanted"]), ("s0", "yyy", "ring beside it", ["shelf"], ["unwanted"])]
    rows += [("s0", f"a{n:03}", f"ring red {n}", ["other"], ["thing"]) for n in range(150)]
    products = spark.createDataFrame(
        [(*r, "instock", None, False, None, None) for r in rows],
        "tenant string, id string, name string, category array<string>, soft_category array<string>, stock_status_canonical string, "
        "stock_status_legacy string, hidden boolean, description string, embedding array<float>",
    )
    log = spark.createDataFrame([("s0", "red ring", True)], "tenant string, query string, in_stock boolean")
    vectors = spark.createDataFrame([], "tenant string, query string, embedding array<float>")
    index = lexical.build_index(products)
    pool = search.ranked_pool(log, products, vectors, index)
    assert pool.filter("id = 'zzz'").isEmpty() and pool.count() == 80
    assert [(r.id, r.similarity_boost) for r in search.expand_second_tier(log, products, vectors, index).collect()] == [("zzz", 0)]


def test_completion_of_every_length(spark):
    rows = [("s0", "1", "Red ring", False), ("s0", "2", "redwood", False), ("s0", "3", "red", True), ("s1", "4", "reddish " + "x" * 30, None)]
    products = spark.createDataFrame([(*r[:3], ["a"], ["redoubt"], "r text", r[3]) for r in rows], "tenant string, id string, name string, category array<string>, soft_category array<string>, description string, hidden boolean")
    trie = completion.stored_trie(lexical.build_index(products), products)
    log = spark.createDataFrame([("s0", " Redwood x "), ("s1", "x" * 25), ("s1", None), ("s1", "")], "tenant string, query string")
    found = {}
    for r in completion.suggestions(completion.typed(log), trie).collect():
        found.setdefault((r.tenant, r.prefix), {})[r.position] = r.id
    assert found["s0", "re"] == found["s0", "red"] == {1: "1", 2: "2"} and found["s0", "redwood"] == {1: "2"}
    assert ("s0", "r") not in found and ("s0", "redwood x") not in found
    assert found["s1", "x" * 20] == {1: "4"} and ("s1", "x" * 21) not in found


def test_query_gate_counts_units(spark):
    rows = spark.createDataFrame([("",), (None,), (" a ",), ("ab",), ("😀",), ("\u00a0b",)], "q string")
    assert [r.ok for r in rows.select(predicates.long_enough(F.col("q")).alias("ok")).collect()] == [False, False, False, True, True, False]


def test_second_tier_respects_categories_and_first_tier(spark):
    products, vectors = bind.products(spark, SF, True, True), bind.query_vectors(spark, SF)
    log = bind.requests(spark, SF)
    ranked = search.ranked_pool(log, products, vectors)
    rows = search.expand_second_tier(log, products, vectors)
    first = ranked.filter("rank < 25").select("lane", "qid", "id")
    assert rows.join(first, ["lane", "qid", "id"], "left_semi").isEmpty()
    shelves = tiers.seeds(ranked).select("lane", "qid", F.col("category").alias("shelf"))
    own = rows.join(bind.products(spark, SF).select("id", "category"), "id")
    outside = own.join(shelves, ["lane", "qid"]).groupBy("lane", "qid", "id").agg(
        F.max(F.arrays_overlap("category", "shelf").cast("int")).alias("inside")
    )
    assert outside.filter("inside = 0").isEmpty()


def test_append_log_ignores_known_keys(spark, tmp_path):
    from vitrine.sources.sinks import append_new, read_log

    folder = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    schema = rows(("a", 1)).schema
    assert read_log(spark, folder, schema).collect() == []
    assert append_new(rows(("a", 2), ("a", 1), ("b", 2)), folder, ["k"], ["v"]) == []
    append_new(rows(("b", 9), ("c", 3), (None, 4)), folder, ["k"], ["v"])
    append_new(rows(), folder, ["k"], ["v"])
    assert sorted(map(tuple, read_log(spark, folder, schema).collect()), key=str) == [("a", 1), ("b", 2), ("c", 3), (None, 4)]


def test_append_reads_only_files_that_may_hold_a_key(spark, tmp_path):
    from vitrine.sources.sinks import append_new, read_log

    folder, n = str(tmp_path / "log"), 8
    batch = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    for lo in (0, 500, 1000):
        assert append_new(batch(lo, lo + 500), folder, ["k"], buckets=n) == []  # no key comes again, no file is read
    opened = append_new(batch(495, 505).union(batch(1500, 2000)), folder, ["k"], buckets=n)
    assert 2 <= len(opened) <= 12 and len({b for b, _ in opened}) == 2  # of 24 files, those with the ten keys
    log = read_log(spark, folder, batch(0, 1).schema)
    assert log.count() == 2000 == log.select("k").distinct().count()
    # a batch that was cut short before its filters is no part of the log
    batch(9000, 9001).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{folder}/rows/batch=lost")
    assert read_log(spark, folder, batch(0, 1).schema).count() == 2000


def test_lexical_blocks_do_not_change_the_result(spark, monkeypatch):
    """Many small cells give the same hits as one cell per lane."""
    from vitrine.operators import lexical

    products = bind.products(spark, SF, description=True)
    searches = fusion.distinct_searches(bind.requests(spark, SF)).withColumn("lane", fusion.lane(F.col("tenant"), F.col("in_stock")))
    index = lexical.stored_index(products)
    whole = fusion.text_hits(searches, products, index)
    plain = blocks.blocked_top_k
    monkeypatch.setattr(lexical, "blocked_top_k", lambda *a, **k: plain(*a, **{**k, "query_rows": 9, "item_rows": 11}))
    cells = fusion.text_hits(searches, products, index)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, whole.collect()))


def test_association_limit_beyond_nine(spark):
    products = spark.createDataFrame(
        [("t", f"p{k:02d}", float(k), False, ["wine"], ["red"]) for k in range(40)],
        "tenant string, id string, boost double, hidden boolean, category array<string>, soft_category array<string>",
    )
    asked = spark.createDataFrame([("t", "q", ["wine"], None, 20), ("t", "r", ["wine"], ["red"], 3)], "tenant string, query string, categories array<string>, soft_categories array<string>, limit int")
    pins = [r.asDict() for r in experiments.association_pins(asked, products).collect()]
    assert sorted(p["id"] for p in pins if p["query"] == "q") == [f"p{k}" for k in range(20, 40)]
    assert sorted(p["id"] for p in pins if p["query"] == "r") == ["p37", "p38", "p39"]


def test_as_of_long_ids(spark):
    rows = [("k", 1, "x" * 45 + "a", "one"), ("k", 1, "x" * 45 + "b", "two")]
    for order in (rows, rows[::-1]):
        left = spark.createDataFrame([("k", 2)], "key string, at int").selectExpr("key", "timestamp_seconds(at) as at")
        right = spark.createDataFrame(order, "key string, t int, id string, v string").selectExpr("key", "timestamp_seconds(t) as t", "id", "v")
        assert running.as_of(left, right, ["key"], "at", "t", "id", ["v"]).first().v == "two"


def test_category_of_five_words(spark):
    products = spark.createDataFrame(
        [("t", ["dry white wine from galilee"], ["dry"])], "tenant string, category array<string>, soft_category array<string>"
    )
    asked = spark.createDataFrame([("t", "a dry white wine from galilee please"), ("t", "nothing here")], "tenant string, query string")
    got = [tuple(r) for r in triggers.longest_category(asked, products).collect()]
    assert got == [("t", "a dry white wine from galilee please", "dry white wine from galilee")]


def test_quota_times_with_the_one_before(spark):
    """Across empty chunks, at negative and null times, and apart by window."""
    times = [0, 1, 39, 40, 41, 400, -7, -90, None]
    rows = [(key, window, at) for key, window in (("a", 10), ("a", 3), ("b", 10)) for at in times] + [("c", 10, 5)]
    made = quota._with_previous(spark.createDataFrame(rows, "key string, window_us long, at long"))
    ordered = sorted(t for t in times if t is not None)
    one = [(None, None), *zip(ordered, [None, *ordered], strict=False)]
    want = [(key, window, at, last) for key, window in (("a", 10), ("a", 3), ("b", 10)) for at, last in one] + [("c", 10, 5, None)]
    assert sorted(map(str, (tuple(r) for r in made.collect()))) == sorted(map(str, want))
    assert made._jdf.queryExecution().logical().toString().count("Union") == 0
