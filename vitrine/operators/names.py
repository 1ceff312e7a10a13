"""Similarity join of texts by normalised edit distance, on equal segments.

Two texts are similar if at most a quarter of the longer one's characters are edited. A text cut into one segment
more than there may be edits keeps one segment whole, and a bounded way from its place, in any similar text. So a name
is cut for each length that a similar query can have, a query gives the substrings that such a segment could be, and both meet
by equality of (tenant, both lengths, segment number, segment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: One edit is allowed per so many characters of the longer text: similarity 0.75.
PER_EDIT = 4


def _edits(a: Column, b: Column) -> Column:
    return F.floor(F.greatest(a, b) / PER_EDIT).cast("int")


def _lengths(n: Column) -> Column:
    """Lengths that a text similar to one of length n can have."""
    nearby = F.sequence(F.greatest(F.lit(1), n - F.floor(n / PER_EDIT).cast("int")), n + F.ceil(n / (PER_EDIT - 1)).cast("int"))
    return F.filter(nearby, lambda m: F.abs(m - n) <= _edits(m, n))


def _segment(i: Column, of: Column, parts: Column) -> tuple[Column, Column]:
    """0-based start and length of segment i of a text of length `of` in `parts`; the last ones take what is left over."""
    size, longer = F.floor(of / parts).cast("int"), of % parts
    over = F.greatest(F.lit(0), i - (parts - longer))
    return i * size + over, size + F.when(i >= parts - longer, 1).otherwise(0)


def _name_keys(text: Column) -> Column:
    own = F.length(text)

    def cut(other: Column) -> Column:
        parts = _edits(own, other) + 1

        def segment(i: Column) -> Column:
            start, size = _segment(i, own, parts)
            return F.struct(other.alias("asked"), own.alias("held"), i.alias("number"), F.substring(text, start + 1, size).alias("segment"))

        return F.transform(F.sequence(F.lit(0), parts - 1), segment)

    return F.flatten(F.transform(_lengths(own), cut))


def _query_keys(text: Column) -> Column:
    own = F.length(text)

    def cut(other: Column) -> Column:
        edits = _edits(own, other)

        def segment(i: Column) -> Column:
            start, size = _segment(i, other, edits + 1)
            # i edits before the segment move it by at most i, the rest after it by at most that many
            low = F.greatest(F.lit(0), start - i, start + own - other - (edits - i))
            high = F.least(own - size, start + i, start + own - other + (edits - i))
            places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda p: F.struct(own.alias("asked"), other.alias("held"), i.alias("number"), F.substring(text, p + 1, size).alias("segment")))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), segment))

    return F.array_distinct(F.flatten(F.transform(_lengths(own), cut)))


def similar(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``(tenant, query, name, edits, similarity)`` of all similar pairs of ``(tenant, query)`` and ``(tenant, name)``.

    Different texts meet once, lower-cased and compared whole; empty ones meet nothing. A frequent segment is a hot
    key of an equality join, which Spark splits.
    """
    lowered = lambda df, c: df.select("tenant", F.lower(c).alias(c)).filter(F.length(c) > 0).distinct()
    left = lowered(queries, "query").select("tenant", "query", F.explode(_query_keys(F.col("query"))).alias("k"))
    right = lowered(names, "name").select("tenant", "name", F.explode(_name_keys(F.col("name"))).alias("k"))
    keys = ["tenant", "asked", "held", "number", "segment"]
    met = left.select("tenant", "query", "k.*").join(right.select("tenant", "name", "k.*"), keys).select("tenant", "query", "name").distinct()
    longer = F.greatest(F.length("query"), F.length("name"))
    edits = F.levenshtein("query", "name")
    return (
        met.withColumn("edits", edits.cast("long")).filter(F.col("edits") <= F.floor(longer / PER_EDIT))
        .withColumn("similarity", F.round((longer - F.col("edits")) / longer, 6))
    )
