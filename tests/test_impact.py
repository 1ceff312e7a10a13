"""Block-max retrieval against the plain one, and numbers given range by range."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from vitrine.operators import impact, lexical, names, running


def test_blocks_left_out_change_nothing(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(150)]
    rows = []
    for i in range(2400):
        first = words[min(rng.randrange(150), rng.randrange(150))]
        name = " ".join([first, *rng.sample(words, rng.randrange(1, 4))])
        rows.append(("s0" if i % 3 else "s1", f"p{i}", name if i % 50 else None, [words[i % 7]], [first[:3]], " ".join(rng.sample(words, 3))))
    products = spark.createDataFrame(rows, "tenant string, id string, name string, category array<string>, soft_category array<string>, description string")
    index = lexical.stored_index(products)
    lanes = products.select(F.concat("tenant", F.lit("|all")).alias("lane"), "tenant", "id").unionByName(
        products.filter("hash(id) % 3 = 0").select(F.concat("tenant", F.lit("|some")).alias("lane"), "tenant", "id")
    )
    asked = [r[2] for r in rows[::150] if r[2]] + [words[3], "nothing here", words[5] + " " + words[5][:-1] + "x"]
    queries = spark.createDataFrame([(f"{t}|{s}", q, t, q) for t in ("s0", "s1") for s in ("all", "some") for q in asked], "lane string, qid string, tenant string, query string")
    found, report = impact.retrieve(queries, lanes, impact.build(products, index, block_rows=8), k=3)
    bag = lambda df: sorted(tuple(r) for r in df.select("lane", "qid", "id", "score", "rank").collect())
    assert bag(found) == bag(lexical.retrieve(queries, lanes, index, k=3))
    opened, blocks = report.agg(F.sum("opened"), F.sum("blocks")).first()
    assert opened < 0.6 * blocks


def test_a_product_of_several_rows_stands_in_one_block(spark):
    """Rows of one product far apart in the order of names: it is found once, as by the plain search."""
    rows = [("s0", f"p{i:02}", f"{chr(97 + i)}aa green" if i % 2 else f"{chr(97 + i)}aa brown", ["t"], ["u"], None) for i in range(20)]
    rows += [("s0", "p01", "zzz green", ["t"], ["u"], None), ("s0", "p03", "yyy green", ["t"], ["u"], None), ("s0", None, "green", ["t"], ["u"], None), (None, "p99", "green", ["t"], ["u"], None)]
    products = spark.createDataFrame(rows, "tenant string, id string, name string, category array<string>, soft_category array<string>, description string")
    index = lexical.stored_index(products)
    lanes = products.select(F.concat("tenant", F.lit("|all")).alias("lane"), "tenant", "id").distinct()
    queries = spark.createDataFrame([("s0|all", q, "s0", q) for q in ("green", "zzz", "brown green")], "lane string, qid string, tenant string, query string")
    found, _ = impact.retrieve(queries, lanes, impact.build(products, index, block_rows=2), k=12)
    bag = lambda df: sorted(tuple(r) for r in df.select("lane", "qid", "id", "score", "rank").collect())
    assert bag(found) == bag(lexical.retrieve(queries, lanes, index, k=12))


def test_one_posting_of_a_term_and_block_is_its_largest(spark):
    rows = [("s0", f"p{i:02}", f"w{i % 5} w{i % 3} green", ["t"], ["u"], "green " * (i % 4) + "red") for i in range(30)]
    products = spark.createDataFrame(rows, "tenant string, id string, name string, category array<string>, soft_category array<string>, description string")
    postings = impact.build(products, lexical.stored_index(products), block_rows=8).postings
    key = ["tenant", "block", "field", "term"]
    want = postings.groupBy(*key).agg(F.max("part"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, postings.filter("most").select(*key, "part").collect()))


def test_of_a_block_only_what_can_enter_leaves_it():
    left = pd.DataFrame({"lane": "a#1", "qid": ["q", "r", "s"], "field": "name", "term": "x", "weight": 1.0, "kth": [2.0, 2.0, np.nan], "last": ["p2", "p9", None]})
    right = pd.DataFrame({"lane": "a#1", "id": ["p1", "p2", "p3", "p4"], "field": "name", "term": "x", "part": [2.0, 2.0, 3.0, 1.0]})
    found = impact._entering(left, right, 4)
    assert sorted(zip(found["qid"], found["id"], strict=True)) == [("q", "p1"), ("q", "p3"), ("r", "p1"), ("r", "p2"), ("r", "p3"), *[("s", f"p{i}") for i in (1, 2, 3, 4)]]


def test_numbers_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else None, i * 7919 % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, value long, id long").repartition(5)
    w = Window.partitionBy("key")
    want = df.select("*", F.row_number().over(w.orderBy(F.desc("value"), "id")).alias("n"), F.count("*").over(w).alias("total"))
    assert sorted(map(tuple, running.numbered(df, ["key"], [F.desc("value"), "id"], "n", "total").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_similar_names_are_all_pairs_within_a_quarter(spark):
    rng = random.Random(8)

    def changed(t, n):
        for _ in range(n):
            at = rng.randrange(len(t) + 1)
            t = rng.choice([t[:at] + t[at + 1 :], t[:at] + rng.choice("abé ") + t[at:], t[:at] + rng.choice("ab") + t[at + 1 :]])
        return t

    base = ["".join(rng.choice("aabbc é") for _ in range(rng.randrange(1, 22))) for _ in range(60)] + ["aaaaaaaaaaaa", "abababababab"]
    asked = [changed(rng.choice(base), rng.randrange(7)) for _ in range(120)] + ["", None, "A"]
    q = spark.createDataFrame([("s", a) for a in asked] + [("t", base[0])], "tenant string, query string")
    n = spark.createDataFrame([("s", b.upper() if i % 2 else b) for i, b in enumerate(base)] + [("s", ""), ("s", None)], "tenant string, name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a.lower(), b.lower()) for a in asked if a for b in base if b and (max(len(a), len(b)) - distance(a.lower(), b.lower())) / max(len(a), len(b)) >= 0.75}
    found = [(r.query, r.name) for r in names.similar(q, n).collect()]
    assert len(found) == len(set(found)) and set(found) == want
