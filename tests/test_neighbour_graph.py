"""The neighbour graph against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vitrine.operators import neighbour_graph, tiers, vector

SF = "/root/testdata/sf0.001"
DIM, ITEMS, ADDED = 16, 3000, 150


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((60, DIM))
    # a third of the items in one cluster, one lane much smaller than the other, and lanes of two and of one item
    own = np.where(rng.random(ITEMS) < 0.33, 0, rng.integers(0, 60, ITEMS))
    points = centres[own] + 0.3 * rng.standard_normal((ITEMS, DIM))
    rows = [("big" if i % 30 else "small", f"i{i}", p.tolist()) for i, p in enumerate(points)]
    rows += [("big", "zero", [0.0] * DIM), ("big", "nothing", None), ("two", "a", points[0].tolist()), ("two", "b", points[1].tolist()), ("one", "c", points[2].tolist())]
    rows += [rows[0]]
    return spark.createDataFrame(rows, "lane string, id string, vector array<double>").cache()


def _sources(items):
    return items.where("vector is not null").dropDuplicates(["lane", "id"]).select("lane", F.col("id").alias("qid"), F.col("id").alias("self_id"), "vector")


def _found(graph, k):
    return graph.withColumnsRenamed({"id": "qid", "other": "id"}).withColumn(
        "rank", F.expr("row_number() over (partition by lane, qid order by score desc, id)")
    ).where(F.col("rank") <= k)


def _share(found, exact):
    return vector.recall(found, exact).where("qid <> 'zero'").agg((F.sum("found") / F.sum("expected")).alias("r")).first()["r"]


@pytest.fixture(scope="module")
def exact(items):
    return vector.nearest(_sources(items), items.where("vector is not null").dropDuplicates(["lane", "id"]), 20).cache()


@pytest.fixture(scope="module")
def graph(items):
    return neighbour_graph.build(items)


def test_recall_and_scores(graph, exact):
    assert _share(_found(graph, 20), exact) >= 0.95
    assert graph.groupBy("lane", "id").count().agg(F.max("count")).first()[0] == neighbour_graph.NEIGHBOURS
    assert graph.where("id = other").isEmpty() and graph.count() == graph.select("lane", "id", "other").distinct().count()
    same = exact.select("lane", F.col("qid").alias("id"), F.col("id").alias("other"), F.col("score").alias("want")).join(graph, ["lane", "id", "other"])
    assert same.agg(F.max(F.abs(F.col("score") - F.col("want")))).first()[0] < 2e-6


def test_small_lanes_and_vectors_without_length(graph):
    assert {(r.id, r.other) for r in graph.where("lane = 'two'").collect()} == {("a", "b"), ("b", "a")}
    assert graph.where("lane = 'one' or id = 'nothing' or other = 'nothing'").isEmpty()
    assert graph.where("id = 'zero'").agg(F.max("score"), F.min("score")).first()[:] == (0.0, 0.0)


def test_added_items(items, exact):
    late = F.pmod(F.xxhash64("id"), F.lit(ITEMS // ADDED)) == 0
    before = neighbour_graph.build(items.where(~late))
    after = neighbour_graph.extended(before, items, items.where(late))
    assert _share(_found(after, 20), exact) >= 0.95
    assert _share(_found(after, 20).join(items.where(late).select("lane", F.col("id").alias("qid")), ["lane", "qid"], "left_semi"),
                  exact.join(items.where(late).select("lane", F.col("id").alias("qid")), ["lane", "qid"], "left_semi")) >= 0.95


def test_what_is_not_listed_is_searched(items, graph):
    """Where few items may be found, or the source is not in the graph, the answer is the exact one."""
    few = items.where("vector is not null").dropDuplicates(["lane", "id"]).where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0)
    new = items.where("id = 'i5'").select("lane", F.lit("new").alias("qid"), F.lit("new").alias("self_id"), "vector")
    sources = _sources(items).where(F.pmod(F.xxhash64("qid"), F.lit(40)) == 1).unionByName(new)
    rows = lambda df: {(r.lane, r.qid, r["rank"]): (r.id, r.score) for r in df.collect()}
    mine, want = rows(neighbour_graph.nearest(sources, few, graph, 10)), rows(vector.nearest(sources, few, 10))
    assert mine.keys() == want.keys() and ("big", "new", 0) in mine
    assert np.mean([mine[key] == want[key] for key in want]) >= 0.95


def test_no_items(spark):
    none = spark.createDataFrame([], "lane string, id string, vector array<double>")
    assert neighbour_graph.build(none).isEmpty()


def test_queries(spark):
    recall = entry.queries()["graph_recall"](spark, SF).agg(F.sum("found"), F.sum("expected")).first()
    assert recall[0] >= 0.95 * recall[1] > 0
    seeds = {name: entry.queries()[name](spark, SF).select("tenant", "seed_id", "id").collect() for name in ("seed_neighbours", "graph_seed_neighbours")}
    assert len(set(seeds["seed_neighbours"]) & set(seeds["graph_seed_neighbours"])) >= 0.95 * len(seeds["seed_neighbours"])


def test_lanes_of_several_cells(items, exact, graph):
    """Cells of far fewer items than a lane, a third of them in one cluster: lists are completed by descent."""
    several = neighbour_graph.build(items, cell=300)
    assert _share(_found(several, 20), exact) >= 0.95
    assert several.groupBy("lane", "id").count().agg(F.max("count")).first()[0] == neighbour_graph.NEIGHBOURS
    assert several.where("id = other").isEmpty() and several.count() == several.select("lane", "id", "other").distinct().count() == graph.count()


def test_added_items_of_lanes_of_several_cells(items, exact):
    late = F.pmod(F.xxhash64("id"), F.lit(ITEMS // ADDED)) == 0
    after = neighbour_graph.extended(neighbour_graph.build(items.where(~late), cell=300), items, items.where(late), cell=300)
    assert _share(_found(after, 20), exact) >= 0.95


def test_a_lane_of_one_cell_is_exact(graph, exact):
    assert _share(_found(graph, 20), exact) == 1.0


def test_equal_vectors_fill_no_cell(spark):
    """More equal vectors than a cell holds are several cells, and every item has a whole list."""
    rows = [("a", f"i{i:04}", [1.0, float(i < 700), 0.5 * (i % 7) * (i >= 700)]) for i in range(1000)]
    equal = spark.createDataFrame(rows, "lane string, id string, vector array<double>")
    found = neighbour_graph.build(equal, k=10, cell=100)
    assert found.groupBy("id").count().agg(F.min("count"), F.count("*")).first()[:] == (10, 1000)
    assert found.where("id < 'i0700'").agg(F.min("score")).first()[0] == 1.0
    sizes = neighbour_graph._placed(neighbour_graph._points(equal), 100).select("item", F.explode("cells").alias("cell")).groupBy("cell").count()
    assert sizes.agg(F.max("count")).first()[0] <= 250


def test_seeds_are_computed_once(spark):
    """What finds the seeds is a whole retrieval; reading their neighbours must not repeat it."""
    rng = np.random.default_rng(5)
    rows = [("s0", f"p{i}", ["t" if i % 2 else "u"], "instock" if i % 3 else None, rng.standard_normal(4).tolist()) for i in range(60)]
    products = spark.createDataFrame(rows, "tenant string, id string, category array<string>, stock_status_canonical string, embedding array<double>")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    seeds = spark.createDataFrame([("s0", f"p{i}") for i in range(0, 60, 4)], "tenant string, id string")
    counting = seeds.mapInPandas(counted, seeds.schema)
    rows = lambda df: sorted(tuple(r) for r in df.select("tenant", "seed_id", "id", "score").collect())
    graph = neighbour_graph.build(tiers.shelf_items(products))
    found = rows(tiers.similar_to_seeds(counting, products, 5, graph))
    assert seen.value == seeds.count()
    assert found == rows(tiers.similar_to_seeds(seeds, products, 5))
