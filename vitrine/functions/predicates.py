"""Row predicates over catalog and log columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitrine.functions import text


def long_enough(query: Column) -> Column:
    """At least two UTF-16 units after trimming; a null query is not."""
    return F.coalesce(F.octet_length(F.encode(text.js_trim(query), "UTF-16BE")) >= 4, F.lit(False))


def visible(hidden: Column) -> Column:
    """Only an explicit true hides a product."""
    return ~F.coalesce(hidden, F.lit(False))


def lenient_stock(canonical: Column, legacy: Column) -> Column:
    """Canonical field if set, else the legacy one, else sellable."""
    return F.coalesce(F.nullif(canonical, F.lit("")), F.nullif(legacy, F.lit("")), F.lit("instock")) == "instock"


def strict_stock(canonical: Column) -> Column:
    """Missing status does not pass: the test of the vector path, facets and alternatives."""
    return F.coalesce(canonical, F.lit("")) == "instock"


def price_between(price: Column, low: Column, high: Column) -> Column:
    """Inclusive, either bound optional; a product without price fails any bound."""
    above = low.isNull() | F.coalesce(price >= low, F.lit(False))
    below = high.isNull() | F.coalesce(price <= high, F.lit(False))
    return above & below


def taxonomy_match(own: Column, wanted: Column) -> Column:
    """Any wanted value contains, or is contained in, any own value; no wish always passes."""
    nothing = F.coalesce(F.size(wanted), F.lit(0)) <= 0
    hit = F.exists(
        own,
        lambda h: F.exists(
            wanted,
            lambda w: F.contains(F.lower(h), F.lower(w)) | F.contains(F.lower(w), F.lower(h)),
        ),
    )
    return nothing | F.coalesce(hit, F.lit(False))


def query_matches(mode: Column, patterns: Column, match_type: Column, query: Column) -> Column:
    """Targeting on the query text; without a query mode everything passes."""
    q = text.js_trim(F.lower(F.coalesce(query, F.lit(""))))
    hit = F.exists(
        F.coalesce(patterns, F.array().cast("array<string>")),
        lambda p: F.when(match_type == "exact", q == text.js_trim(F.lower(p))).otherwise(
            F.contains(q, text.js_trim(F.lower(p)))
        ),
    )
    return F.when(F.coalesce(mode, F.lit("")) == "queryMatch", (q != "") & hit).otherwise(F.lit(True))


def hour_matches(ts: Column, zone: Column, start: Column, end: Column) -> Column:
    """[start, end) hours on the clock of a zone, wrapping midnight; start = end is the whole day."""
    hour = F.hour(F.from_utc_timestamp(ts, zone))
    inside = (
        F.when(start == end, F.lit(True))
        .when(start < end, (hour >= start) & (hour < end))
        .otherwise((hour >= start) | (hour < end))
    )
    return F.when(zone.isNull(), F.lit(True)).otherwise(inside)


def recent(ts: Column, as_of: Column, days: int | None) -> Column:
    """Last N days, N clamped to 1-365, 30 when absent or zero."""
    span = min(max(days or 30, 1), 365)
    return ts >= as_of - F.expr(f"INTERVAL {span} DAYS")


def clamp_limit(value: Column, default: int, low: int, high: int) -> Column:
    chosen = F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(default)).otherwise(value)
    return F.least(F.greatest(chosen, F.lit(low)), F.lit(high))
