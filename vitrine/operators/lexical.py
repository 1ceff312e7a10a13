"""Weighted lexical retrieval over token postings.

Scores are BM25 (k1 = 1.2, b = 0.75) per field, with corpus statistics per tenant. A query token
reaches an index token exactly or within one edit; each way carries its own field weight.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.text import index_tokens
from vitrine.operators.blocks import best_rows, blocked_top_k
from vitrine.session import checkpointed, run_folder, written

K1, B = 1.2, 0.75
POOL = 80
# --- Fixed values: field weights of an exact token and of a token one edit away ----------------------
EXACT_WEIGHT = {"name": 8.0, "category": 4.0, "soft_category": 4.0, "description": 1.0}
FUZZY_WEIGHT = {"name": 3.0, "category": 2.0, "soft_category": 2.0}
PREFIX_MIN = 2
PREFIX_MAX = {"name": 20, "description": 20, "category": 15, "soft_category": 15}
# -------------------------------------------------------------------------------------------------

#: Field name of tags that a query demands; no index field has it.
TAG = "#tag"


@dataclass
class TextIndex:
    postings: DataFrame  # tenant, field, token, id, tf, dl
    tokens: DataFrame  # tenant, field, token, df
    fields: DataFrame  # tenant, field, docs, avg_dl


def field_texts(products: DataFrame) -> DataFrame:
    """One row per product and indexed field, list fields joined to one text.

    Descriptions are a branch of their own, so that plans over the short fields never read them.
    """
    short = F.array(
        F.struct(F.lit("name").alias("field"), F.col("name").alias("text")),
        F.struct(F.lit("category").alias("field"), F.array_join("category", " ").alias("text")),
        F.struct(F.lit("soft_category").alias("field"), F.array_join("soft_category", " ").alias("text")),
    )
    return (
        products.select("tenant", "id", F.inline(short))
        .unionByName(products.select("tenant", "id", F.lit("description").alias("field"), F.col("description").alias("text")))
        .filter("text is not null")
    )


def field_text(products: DataFrame, field: str) -> DataFrame:
    """The rows of ``field_texts`` of one field."""
    text = F.col(field) if field in ("name", "description") else F.array_join(field, " ")
    return products.select("tenant", "id", F.lit(field).alias("field"), text.alias("text")).filter("text is not null")


def _counted(texts: DataFrame) -> DataFrame:
    """Token counts of each row of ``texts``: words are sorted inside the row, so nothing is shuffled."""
    words = texts.select("tenant", "field", "id", F.sort_array(index_tokens(F.col("text"))).alias("words"))
    # where each different word begins; element_at counts from 1
    begins = F.filter(
        F.sequence(F.lit(1), F.size("words")),
        lambda i: (i == 1) | (F.element_at("words", i) != F.element_at("words", F.greatest(i - 1, F.lit(1)))),
    )
    runs = words.filter(F.size("words") > 0).select("*", F.size("words").alias("n"), begins.alias("begins"))
    # explode_outer: a plain explode makes Spark tokenise once more to test for empty lists.
    return runs.select("tenant", "field", "id", "words", "n", "begins", F.posexplode_outer("begins").alias("at", "begin")).select(
        "tenant", "field", F.element_at("words", F.col("begin")).alias("token"), "id",
        (F.coalesce(F.get("begins", F.col("at") + 1), F.col("n") + 1) - F.col("begin")).cast("long").alias("tf"), F.col("n").cast("long").alias("dl"),
    )


def _repeated(products: DataFrame) -> DataFrame | None:
    """(tenant, id) of products with several rows, or nothing where there are none."""
    found = checkpointed(products.groupBy("tenant", "id").agg(F.count("*").alias("n")).filter("n > 1").select("tenant", "id"))
    return None if found.isEmpty() else found


def postings(products: DataFrame) -> DataFrame:
    """Token counts per product and field, with the field's length in tokens."""
    return _postings(products, _repeated(products))


def _postings(products: DataFrame, repeated: DataFrame | None, texts: Callable[[DataFrame], DataFrame] = field_texts) -> DataFrame:
    if repeated is None:
        return _counted(texts(products))
    # rows of one product and equal length count as one text
    same = products["tenant"].eqNullSafe(repeated["tenant"]) & products["id"].eqNullSafe(repeated["id"])
    merged = _counted(texts(products.join(repeated, same, "left_semi"))).groupBy("tenant", "field", "token", "id", "dl").agg(F.sum("tf").alias("tf"))
    return _counted(texts(products.join(repeated, same, "left_anti"))).unionByName(merged)


def build_index(products: DataFrame) -> TextIndex:
    """The index as one lazy plan, for catalogs read once; see ``stored_index`` for reuse."""
    return statistics(postings(products))


def statistics(post: DataFrame) -> TextIndex:
    """Document counts per token and mean lengths per field, from postings."""
    tokens = post.groupBy("tenant", "field", "token").agg(F.count("*").alias("df"))
    fields = post.groupBy("tenant", "field", "id").agg(F.max("dl").alias("dl")).groupBy("tenant", "field").agg(
        F.count("*").alias("docs"), (F.sum("dl") / F.count("*")).alias("avg_dl")
    )
    return TextIndex(post, tokens, fields)


def stored_index(products: DataFrame, folder: str | None = None) -> TextIndex:
    """Build the index once and read it back: texts are tokenised a single time.

    Postings are partitioned by field, so plans over the short fields skip the descriptions. Token
    and field statistics are counted from the stored postings.
    """
    spark = products.sparkSession
    folder = folder or run_folder(spark, "text-index")
    repeated = _repeated(products)
    for field in EXACT_WEIGHT:
        # a folder a field, each written by itself: rows need not be sorted by field before they are written
        one = _postings(products, repeated, lambda rows, field=field: field_text(rows, field))
        one.drop("field").write.mode("overwrite").parquet(f"{folder}/postings/field={field}")
    post = spark.read.parquet(f"{folder}/postings").select("tenant", "field", "token", "id", "tf", "dl")
    counted = statistics(post)
    counted.tokens.write.mode("overwrite").partitionBy("field").parquet(f"{folder}/tokens")
    counted.fields.write.mode("overwrite").parquet(f"{folder}/fields")
    tokens, fields = (spark.read.parquet(f"{folder}/{n}") for n in ("tokens", "fields"))
    return TextIndex(post, tokens.select("tenant", "field", "token", "df"), fields)


def _longest_prefix() -> Column:
    sizes = F.create_map(*[x for f, n in PREFIX_MAX.items() for x in (F.lit(f), F.lit(n))])
    return sizes[F.col("field")]


def _edge_grams(word: Column, longest: Column) -> Column:
    """Prefixes of a word from the shortest indexed size on; too short words have none."""
    return F.when(
        F.length(word) >= PREFIX_MIN,
        F.transform(
            F.sequence(F.lit(PREFIX_MIN), F.least(F.length(word), longest)), lambda n: F.substring(word, F.lit(1), n)
        ),
    )


def prefixes(products: DataFrame) -> DataFrame:
    """Edge n-grams per product and field."""
    words = field_texts(products).select(
        "tenant", "field", "id", F.array_distinct(index_tokens(F.col("text"))).alias("words")
    )
    grams = F.transform(
        F.filter("words", lambda w: F.length(w) >= PREFIX_MIN), lambda w: _edge_grams(w, _longest_prefix())
    )
    # A row is one product field, so removing repeats inside it needs no shuffle.
    listed = words.select("tenant", "field", "id", F.explode_outer(F.array_distinct(F.flatten(grams))).alias("prefix"))
    return listed.filter("prefix is not null")


def one_edit_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(tenant, token, other, edits) for tokens at most one edit apart, by an equi-join.

    Two tokens within one edit share themselves or one of their one-character deletions, so the
    deletions are the join key. Tokens are distinct on both sides; those sharing one deletion differ
    in a single inserted character, so a key group is bounded by the alphabet, not by the data.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        cuts = F.transform(
            F.sequence(F.lit(1), F.length("token")),
            lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.length("token"))),
        )
        keys = F.array_distinct(F.concat(F.array("token"), cuts))
        words = df.select("tenant", "token").distinct().withColumn("cut", F.explode(keys))
        return words.withColumnRenamed("token", name)

    pairs = keyed(left, "token").join(keyed(right, "other"), ["tenant", "cut"])
    edits = F.levenshtein("token", "other", 1)
    return (
        pairs.filter(edits >= 0)
        .select("tenant", "token", "other", edits.cast("long").alias("edits"))
        .distinct()
    )


def reachable_terms(query_tokens: DataFrame, index: TextIndex) -> DataFrame:
    """(tenant, token, term, edits): the token itself and index tokens of fuzzy fields one edit away."""
    exact = query_tokens.select("tenant", "token").distinct()
    near = one_edit_pairs(exact, index.tokens.filter(F.col("field").isin(*FUZZY_WEIGHT))).filter("edits = 1")
    return near.select("tenant", "token", F.col("other").alias("term"), F.lit(1).alias("edits")).unionByName(
        exact.select("tenant", "token", F.col("token").alias("term"), F.lit(0).alias("edits"))
    )


def term_weights(reach: DataFrame, index: TextIndex) -> DataFrame:
    """(tenant, token, field, term, weight): index terms a query token reaches, weight x idf.

    Index tokens are cut to the reached ones first, a filter Catalyst moves below the counting.
    """
    as_map = lambda w: F.create_map(*[x for f, v in w.items() for x in (F.lit(f), F.lit(v))])
    weight = F.when(F.col("edits") == 0, as_map(EXACT_WEIGHT)[F.col("field")]).otherwise(
        F.coalesce(F.try_element_at(as_map(FUZZY_WEIGHT), F.col("field")), F.lit(0.0))
    )
    needed = reach.select("tenant", F.col("term").alias("token")).distinct()
    terms = (
        index.tokens.join(needed, ["tenant", "token"], "left_semi")
        .withColumnRenamed("token", "term")
        .join(index.fields, ["tenant", "field"])
    )
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (
        reach.join(terms, ["tenant", "term"])
        .select("tenant", "token", "field", "term", (weight * idf).alias("weight"))
        .filter("weight > 0")
    )


def bm25_cell(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Sum weighted term scores of a cell's documents per query, best k each."""
    ids, doc = np.unique(right["id"].to_numpy().astype(str), return_inverse=True)
    ranks = np.arange(len(ids))
    demands = (left["field"] == TAG).to_numpy()
    terms = right["field"] + "|" + right["term"]
    where = {t: (doc[p], right["part"].to_numpy()[p]) for t, p in terms.groupby(terms).indices.items()}
    asked, chosen, found_scores = [], [], []
    wanted = (left["field"] + "|" + left["term"]).to_numpy()
    weights = left["weight"].to_numpy()
    for qid, rows in left.groupby("qid").indices.items():
        scores = np.zeros(len(ids))
        for r in rows[~demands[rows]]:
            hit = where.get(wanted[r])
            if hit is not None:
                scores[hit[0]] += weights[r] * hit[1]
        if demands[rows].any():
            allowed = np.zeros(len(ids), bool)
            for t in wanted[rows[demands[rows]]]:
                if t in where:
                    allowed[where[t][0]] = True
            scores[~allowed] = 0.0
        found = np.flatnonzero(scores)
        rounded = np.round(scores[found], 6)
        best = best_rows(rounded, ranks[found], k)
        asked.append(qid)
        chosen.append(found[best])
        found_scores.append(rounded[best])
    # one frame a cell: a frame a query would cost more than its scores
    row = np.repeat(np.arange(len(asked)), [len(best) for best in chosen])
    qids = np.array(asked, object)[row]
    return pd.DataFrame({"lane": left["lane"].iloc[0], "qid": qids, "id": ids[np.concatenate(chosen)], "score": np.concatenate(found_scores)})


def _words(queries: DataFrame) -> DataFrame:
    return queries.select("lane", "qid", "tenant", F.explode(F.array_distinct(index_tokens(F.col("query")))).alias("token"))


def _weighted(words: DataFrame, reach: DataFrame, index: TextIndex) -> DataFrame:
    return words.join(term_weights(reach, index), ["tenant", "token"]).groupBy("lane", "qid", "field", "term").agg(F.sum("weight").alias("weight"))


def _reached(queries: DataFrame, index: TextIndex) -> tuple[DataFrame, DataFrame]:
    """The words of the queries and the terms they reach, both written: read by several joins, and far fewer than postings."""
    words = written(_words(queries), "query-words")
    return words, written(reachable_terms(words, index), "reached-terms")


def query_weights(queries: DataFrame, index: TextIndex) -> DataFrame:
    """(lane, qid, field, term, weight): all index terms that a query reaches."""
    words, reach = _reached(queries, index)
    return _weighted(words, reach, index)


def term_part(tf: Column, dl: Column, avg_dl: Column) -> Column:
    """What a term's count in a field of a given length adds, before its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def retrieve(
    queries: DataFrame, lanes: DataFrame, index: TextIndex, k: int = POOL, tags: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Best k products per query.

    ``queries(lane, qid, tenant, query)`` are distinct searches; ``lanes(lane, tenant, id)`` lists
    the products eligible in each lane. ``tags`` are ``(lane, qid, tag)`` and ``(lane, id, tag)``: every query
    then finds only products that share a tag with it. Tags are one more posting list of a cell, so
    the filter holds before the best k are taken.
    """
    words, reach = _reached(queries, index)
    q = _weighted(words, reach, index)
    needed = reach.select("tenant", F.col("term").alias("token")).distinct()
    part = term_part(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    items = (
        index.postings.join(needed, ["tenant", "token"], "left_semi")
        .join(index.fields, ["tenant", "field"])
        .select("tenant", "id", "field", F.col("token").alias("term"), part.alias("part"))
        .join(lanes, ["tenant", "id"])
        .select("lane", "id", "field", "term", "part")
    )
    if tags:
        asked, held = tags
        q = q.unionByName(asked.select("lane", "qid", F.lit(TAG).alias("field"), F.col("tag").alias("term"), F.lit(0.0).alias("weight")))
        items = items.unionByName(held.select("lane", "id", F.lit(TAG).alias("field"), F.col("tag").alias("term"), F.lit(0.0).alias("part")))
    return blocked_top_k(q, items, bm25_cell, k, sized_by=(queries, lanes))
