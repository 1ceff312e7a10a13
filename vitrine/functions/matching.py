"""Similarity, name-match bonus, hashing and score expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from vitrine.functions import text

# --- Fixed values -------------------------------------------------------------------------------
HIGH_TEXT_MATCH = 20_000
SEED_BONUS = 50_000
RRF_K = 60
TEXT_WEIGHT = 2
VECTOR_WEIGHT = 1
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
BUCKETS = 10_000
# -------------------------------------------------------------------------------------------------


def similarity(a: Column, b: Column) -> Column:
    """(longer - edits) / longer, 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise((longer - F.levenshtein(a, b)) / longer)


def name_match_bonus(name: Column, query: Column, cleaned: Column) -> Column:
    """How well a product name answers a query, from exact name down to a misspelt word."""
    n = text.js_trim(F.lower(name))
    q = text.js_trim(F.lower(query))
    c = text.js_trim(F.lower(F.coalesce(cleaned, F.lit(""))))
    words = F.split(q, f"{text.WHITESPACE}+")
    count = F.size(words)
    found = F.size(F.filter(words, lambda w: (F.length(w) > 2) & F.contains(n, w)))
    comparable = (F.length(q) >= 3) & (F.length(n) >= 3)
    near_word = F.exists(
        F.split(n, f"{text.WHITESPACE}+"), lambda w: (F.length(w) >= 3) & (similarity(q, w) >= 0.75)
    )
    ladder = [
        ((F.coalesce(name, F.lit("")) == "") | (F.coalesce(query, F.lit("")) == ""), 0),
        (n == q, 100_000),
        ((c != "") & (n == c), 90_000),
        (F.contains(n, q), 60_000),
        ((c != "") & F.contains(n, c), 50_000),
        ((count > 1) & F.contains(n, F.array_join(words, " ")), 40_000),
        ((count > 1) & (found >= F.ceil(count * F.lit(0.7))), 15_000),
        ((count > 1) & (found >= 2), 12_000),
        (comparable & (similarity(q, F.substring(n, 1, 30)) >= 0.75), 10_000),
        (comparable & near_word, 12_000),
    ]
    first, *rest = ladder
    chain = reduce(lambda acc, step: acc.when(*step), rest, F.when(*first))
    return chain.otherwise(0).cast("long")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as a non-negative long."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    size = (F.length(raw) / 4).cast("int")
    positions = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    codes = F.transform(
        positions, lambda i: F.conv(F.substring(raw, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("long")
    )
    return F.aggregate(
        codes,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(4294967295)),
    )


def traffic_bucket(experiment: Column, session: Column) -> Column:
    return F.pmod(fnv1a(F.concat(experiment, F.lit(":"), session)), F.lit(BUCKETS))


def rrf(rank: Column, weight: float) -> Column:
    """Reciprocal-rank share of a 0-based rank."""
    return F.lit(float(weight)) / (F.lit(RRF_K) + rank + 1)


def soft_matches(own: Column, wanted: Column) -> Column:
    return F.size(F.array_intersect(own, wanted)).cast("long")
