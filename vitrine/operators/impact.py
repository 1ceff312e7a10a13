"""Lexical top-k that ends early: products in blocks, with the largest impact of every term in each block stored.

A query's score in a block is at most the sum of its weights times those largest impacts. The blocks of the
highest bounds are scored first; of the others only those whose bound reaches the k-th score found are opened.
Postings are kept by block and term, so a block's task reads the terms that its queries have and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrine.operators import lexical
from vitrine.operators.blocks import blocked_top_k, ranked
from vitrine.operators.running import numbered
from vitrine.session import checkpointed, run_folder, written

POOL = 80
#: Products of a block at least, and blocks of a tenant at most: a query has no more bounds than that.
BLOCK_ROWS, MAX_BLOCKS = 256, 4096
#: Blocks scored for the first threshold.
FIRST = 2


@dataclass
class ImpactIndex:
    postings: DataFrame  # tenant, block, field, term, id, part, most: whether the part is the term's largest in the block
    text: lexical.TextIndex


def build(products: DataFrame, index: lexical.TextIndex, block_rows: int = BLOCK_ROWS, folder: str | None = None) -> ImpactIndex:
    """Impacts of all postings by block, one stored table in which the largest impact of a term in a block is marked.

    Blocks are runs of the name order of a tenant, so that similar products share blocks and bounds differ. Postings meet the
    places of their products once and are dealt by block once; the maxima are found where the postings are written.
    """
    spark = products.sparkSession
    folder = folder or run_folder(spark, "impact-index")
    rows = numbered(products.select("tenant", "id", F.coalesce("name", F.lit("")).alias("name")), ["tenant"], ["name", "id"], "place", "total")
    size = F.greatest(F.lit(block_rows), F.ceil(F.col("total") / MAX_BLOCKS))
    # a product of several rows stands in one block
    places = rows.groupBy("tenant", "id").agg(F.min(F.floor((F.col("place") - 1) / size).cast("int")).alias("block"))
    part = lexical.term_part(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    impacts = (
        # places are few beside postings, which a hash join does not have to sort
        index.postings.join(index.fields, ["tenant", "field"]).join(places.hint("shuffle_hash"), ["tenant", "id"])
        .select("tenant", "block", "field", F.col("token").alias("term"), "id", part.alias("part"))
    )
    best = Window.partitionBy("block", "tenant", "term", "field").orderBy(F.desc("part"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = impacts.repartition(tasks, "tenant", "block").withColumn("most", F.row_number().over(best) == 1)
    marked.write.mode("overwrite").parquet(folder)
    return ImpactIndex(spark.read.schema(marked.schema).parquet(folder), index)


def _cell(block: Column) -> Column:
    return F.concat(F.col("lane"), F.lit("#"), block.cast("string"))


def _entering(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """A block's best k of each query, without those that come after the query's k-th row of the first blocks."""
    found = lexical.bm25_cell(left, right, k)
    limits = left.drop_duplicates("qid").set_index("qid").reindex(found["qid"])
    kth, last, score = limits["kth"].to_numpy(float), limits["last"].to_numpy(object), found["score"].to_numpy()
    before = score > kth
    tied = np.flatnonzero(score == kth)
    before[tied] = found["id"].to_numpy(object)[tied] < last[tied]
    return found[before | np.isnan(kth)]


def retrieve(queries: DataFrame, lanes: DataFrame, index: ImpactIndex, k: int = POOL, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """Best k products per query, as ``lexical.retrieve`` finds them, and ``(lane, qid, blocks, opened)``.

    ``blocks`` counts those in which a query has a term at all.
    """
    tenants = queries.select("lane", "qid", "tenant").distinct()
    # a few terms a query; read by every pass
    weights = written(lexical.query_weights(queries, index.text).join(tenants, ["lane", "qid"]), "query-weights")
    terms = weights.select("tenant", "field", "term").distinct()
    # of all postings those of the queries' terms, for the bounds and both passes; whatever else the index has is read once and not shuffled
    postings = written(index.postings.join(terms, ["tenant", "field", "term"], "left_semi"), "reached-postings")
    most = postings.filter("most").select("tenant", "field", "term", "block", F.col("part").alias("most"))
    bounds = weights.join(most, ["tenant", "field", "term"]).groupBy("lane", "qid", "tenant", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
    by_bound = Window.partitionBy("lane", "qid").orderBy(F.desc("bound"), "block")
    bounds = checkpointed(bounds.withColumn("n", F.row_number().over(by_bound)))

    def scored(opened: DataFrame) -> DataFrame:
        """Best k of each query in the blocks it opens, of those that can enter where ``kth`` and ``last`` are known."""
        wanted = opened.join(weights, ["lane", "qid", "tenant"]).select("lane", "tenant", "block", "qid", "field", "term", "weight", "kth", "last")
        needed = wanted.select("lane", "tenant", "block", "field", "term").distinct()
        held = needed.join(postings, ["tenant", "block", "field", "term"]).join(lanes, ["lane", "tenant", "id"])
        cells = opened.select(_cell(F.col("block")).alias("lane"), "qid")
        found = blocked_top_k(
            wanted.select(_cell(F.col("block")).alias("lane"), "qid", "field", "term", "weight", "kth", "last"),
            held.select(_cell(F.col("block")).alias("lane"), "id", "field", "term", "part"), _entering, k,
            # a block is one cell of items, however many there are
            item_rows=1 << 40, sized_by=(cells, needed.select(_cell(F.col("block")).alias("lane"), F.lit("").alias("id"))),
        )
        return found.withColumn("lane", F.regexp_replace("lane", "#[0-9]+$", "")).drop("rank")

    unknown = [F.lit(None).cast("double").alias("kth"), F.lit(None).cast("string").alias("last")]
    begun = checkpointed(ranked(scored(bounds.filter(F.col("n") <= first).select("*", *unknown)), k).drop("rank"))
    full = begun.groupBy("lane", "qid").agg(F.min("score").alias("kth"), F.max_by("id", F.struct(-F.col("score"), "id")).alias("last"), F.count("*").alias("found"))
    kth = full.filter(F.col("found") >= k).drop("found")
    # scores are compared to six places
    open_ = F.col("kth").isNull() | (F.col("bound") + 1e-6 >= F.col("kth"))
    more = checkpointed(bounds.filter(F.col("n") > first).join(kth, ["lane", "qid"], "left").filter(open_).select("lane", "qid", "tenant", "block", "kth", "last"))
    counts = bounds.groupBy("lane", "qid").agg(F.count("*").alias("blocks"), F.count_if(F.col("n") <= first).alias("begun"))
    report = counts.join(more.groupBy("lane", "qid").agg(F.count("*").alias("more")), ["lane", "qid"], "left").select(
        "lane", "qid", "blocks", (F.col("begun") + F.coalesce("more", F.lit(0))).alias("opened")
    )
    return ranked(begun.unionByName(scored(more)), k), report
