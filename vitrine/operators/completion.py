"""Completion trie: for everything a shopper may have typed so far, the best products."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.functions import predicates, text
from vitrine.operators.lexical import PREFIX_MAX, PREFIX_MIN, TextIndex
from vitrine.session import run_folder

BEST = 10
#: Fields in order of preference.
FIELDS = ("name", "category", "soft_category", "description")
_BEST = "array<struct<place:int,id:string>>"


def _best(lists: Column, k: int) -> Column:
    """The first k products of several lists by (field place, id), each with its first place."""
    ordered = F.array_sort(F.flatten(lists))
    kept = F.aggregate(
        ordered, F.array().cast(_BEST), lambda done, x: F.when(F.exists(done, lambda y: y["id"] == x["id"]) | (F.size(done) >= k), done).otherwise(F.concat(done, F.array(x)))
    )
    return kept


def leaves(index: TextIndex, products: DataFrame, k: int = BEST) -> DataFrame:
    """``(tenant, longest, best)``: the prefix where a token enters the trie, and its first k visible products.

    A token enters at its whole length or the longest prefix that its field indexes. The first k products per
    field are taken with a window that Spark limits before its shuffle, so a frequent token costs k products a task. A
    product that enters by several tokens has one dense rank, so entries need no shuffle of their own to be made distinct.
    """
    sizes = F.create_map(*[x for f, n in PREFIX_MAX.items() for x in (F.lit(f), F.lit(n))])
    places = F.create_map(*[x for n, f in enumerate(FIELDS) for x in (F.lit(f), F.lit(n))])
    visible = products.filter(predicates.visible(F.col("hidden"))).select("tenant", "id")
    entries = index.postings.filter(F.length("token") >= PREFIX_MIN).select(
        "tenant", F.substring("token", F.lit(1), sizes[F.col("field")]).alias("longest"), places[F.col("field")].alias("place"), "id"
    )
    w = Window.partitionBy("tenant", "longest", "place").orderBy("id")
    first = (
        entries.join(visible, ["tenant", "id"]).withColumn("n", F.dense_rank().over(w)).filter(F.col("n") <= k)
        .groupBy("tenant", "longest").agg(F.collect_set(F.struct("place", "id")).alias("own"))  # at most k a field
    )
    return first.select("tenant", "longest", _best(F.array("own"), k).alias("best"))


def stored_trie(index: TextIndex, products: DataFrame, folder: str | None = None, k: int = BEST) -> DataFrame:
    """``(tenant, prefix, best)`` for every prefix of every token, as a stored table.

    Built from the longest prefixes up: a node merges the k best of its children, which are as many as
    there are letters, and of the tokens that end there. Postings are read once, for the leaves; each
    level reads the one below, a row a node. Products that a level cuts cannot return higher up, as a node's
    order is that of its children.
    """
    spark = products.sparkSession
    folder = folder or run_folder(spark, "completion-trie")
    place = lambda depth: os.path.join(folder, "nodes", f"depth={depth}")
    leaves(index, products, k).withColumn("depth", F.length("longest")).write.mode("overwrite").partitionBy("depth").parquet(f"{folder}/leaves")
    entering = spark.read.schema(f"tenant string, longest string, best {_BEST}, depth int").parquet(f"{folder}/leaves")
    schema = f"tenant string, prefix string, best {_BEST}"
    for depth in range(max(PREFIX_MAX.values()), PREFIX_MIN - 1, -1):
        here = entering.filter(F.col("depth") == depth).select("tenant", F.col("longest").alias("prefix"), "best")
        if depth < max(PREFIX_MAX.values()):
            below = spark.read.schema(schema).parquet(place(depth + 1))
            here = here.unionByName(below.withColumn("prefix", F.substring("prefix", 1, depth)))
        here.groupBy("tenant", "prefix").agg(_best(F.collect_list("best"), k).alias("best")).write.mode("overwrite").parquet(place(depth))
    return spark.read.schema(schema).parquet(*[place(d) for d in range(PREFIX_MIN, max(PREFIX_MAX.values()) + 1)])


def typed(queries: DataFrame) -> DataFrame:
    """``(tenant, prefix)``: what stands in the search box at every length of every query, once each.

    Longer than the longest indexed prefix nothing can match, so no more is spelled out.
    """
    asked = queries.select("tenant", F.lower(text.js_trim("query")).alias("query")).distinct()
    lengths = F.sequence(F.lit(1), F.least(F.length("query"), F.lit(max(PREFIX_MAX.values()) + 1)))
    spelled = F.when(F.length("query") > 0, F.transform(lengths, lambda n: text.js_trim(F.substring("query", F.lit(1), n))))
    return asked.select("tenant", F.explode(spelled).alias("prefix")).distinct()


def suggestions(prefixes: DataFrame, trie: DataFrame) -> DataFrame:
    """``(tenant, prefix, id, position)`` of each typed prefix that starts a token: one lookup, no postings."""
    found = trie.join(prefixes, ["tenant", "prefix"], "left_semi")
    return found.select("tenant", "prefix", F.posexplode("best").alias("at", "b")).select(
        "tenant", "prefix", F.col("b.id").alias("id"), (F.col("at") + 1).alias("position")
    )
