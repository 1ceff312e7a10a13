"""Inverted lists against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import inverted_lists, vector

DIM, CLUSTERS, ITEMS = 16, 120, 9000


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((CLUSTERS, DIM))
    # a third of the items in one cluster, and one lane much smaller than the other
    own = np.where(rng.random(ITEMS) < 0.33, 0, rng.integers(0, CLUSTERS, ITEMS))
    points = centres[own] + 0.2 * rng.standard_normal((ITEMS, DIM))
    items = [("big" if i % 30 else "small", f"i{i}", p.tolist()) for i, p in enumerate(points)]
    items += [("big", "zero", [0.0] * DIM), ("one", "only", points[0].tolist())]
    asked = centres[rng.integers(0, CLUSTERS, 40)] + 0.2 * rng.standard_normal((40, DIM))
    queries = [("big", f"q{j}", v.tolist()) for j, v in enumerate(asked)] + [("small", "q0", asked[0].tolist()), ("one", "q1", asked[1].tolist()), ("none", "q2", asked[2].tolist())]
    q = spark.createDataFrame(queries, "lane string, qid string, vector array<double>")
    i = spark.createDataFrame(items, "lane string, id string, vector array<double>")
    return q, i, inverted_lists.build(i), vector.nearest(q, i)


def test_every_item_is_in_one_list(data):
    _, items, index, _ = data
    assert index.items.count() == items.count() == index.items.select("lane", "id").distinct().count()
    assert index.lists.agg(F.sum("size")).first()[0] == items.count()


def test_recall_with_few_items_scored(data):
    q, items, index, exact = data
    found = inverted_lists.nearest_approx(q, index, share=0.1, rerank=4)
    share = vector.recall(found, exact).filter("lane = 'big'").agg((F.sum("found") / F.sum("expected")).alias("r")).first()["r"]
    assert share >= 0.95
    assert 4 * inverted_lists.POOL <= 0.05 * items.filter("lane = 'big'").count()  # all that is scored with whole vectors
    exact_rows = {(r.lane, r.qid, r.id): r.score for r in exact.collect()}
    for r in found.collect():
        assert abs(exact_rows.get((r.lane, r.qid, r.id), r.score) - r.score) < 2e-6


def test_pruned_search_is_exact(data):
    q, _, index, exact = data
    found, report = inverted_lists.nearest_pruned(q, index, 20)
    key = lambda r: (r.lane, r.qid, r["rank"])
    mine, want = {key(r): (r.id, r.score) for r in found.collect()}, {key(r): (r.id, r.score) for r in exact.filter("rank < 20").collect()}
    assert mine == want
    rows = report.filter("lane = 'big'").agg(F.sum("opened"), F.sum("lists")).first()
    assert rows[0] < 0.5 * rows[1]  # lists that cannot hold a better item are not read


def test_queries_of_a_pruned_search_are_computed_once(spark, data):
    q, _, index, _ = data
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    found, _ = inverted_lists.nearest_pruned(q.mapInPandas(counted, q.schema), index, 20)
    assert not found.isEmpty() and seen.value == q.count()
