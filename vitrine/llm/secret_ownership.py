"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text: assignments of secrets, access keys, long hexadecimal runs, and bare tokens
of 20 characters or more that mix upper case, lower case and digits. Each candidate's value is hashed; Spark counts for each hash
the distinct repositories, owners, texts and passages (the value with `AROUND` characters on either side) that hold it.

Copies of one text are one holder, whoever owns them: a value's spread is the number of its owners, or one and
the number of texts that the owner of most of them does not hold, whichever is less. A value of spread `OWNER_LIMIT` at most is
owner-specific and taken for live. So is one of more owners in up to `HANDFUL` different texts if a name or form tells
that it is a secret (the base kinds), or if it stands in one and the same passage everywhere, copied along with it. The
others are widely copied examples. The base kinds are always reported, with that class; a bare token, which has no name
beside it to tell it is a secret, is reported only if it is live.

Counts go through (hash, owner, text) and (hash, text) to the hash, each summed on the map side first, so a
value held by a third of all rows stays small. For the given table an owner is a source and a repository is a document.

Null text: no spans. A null owner or repository counts as one unnamed one. Repeated rows are the same repository, and
each gives its row. Spans are code points, end exclusive; ties in start go by kind in the order listed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from vitrine.llm.common import by_batch, lists, whole_rows
from vitrine.session import checkpointed

KINDS = ["assign", "access", "hex", "bare"]
#: Owners that an owner-specific value has at most.
OWNER_LIMIT = 1
#: Different texts up to which a value of several owners is not yet widely copied.
HANDFUL = 8
#: Characters on either side of a value that make its passage.
AROUND = 32

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
_MIXED = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", re.S)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number of the kind, value), by start and kind; bare tokens only where no base span is touched."""
    found = [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    base = sorted((s, e) for s, e, _, _ in found)
    begins, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    for m in _BARE.finditer(text):
        before = bisect_left(begins, m.end())  # base spans that start before the token ends
        if _MIXED.match(m[0]) and not (before and reach[before - 1] > m.start()):
            found.append((m.start(), m.end(), 3, m[0]))
    return sorted(found, key=lambda f: (f[0], f[2]))


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in spans)


def _find(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, digests, found, sizes, passages = [], [], [], [], []
    for text in batch.column("text").to_pylist():
        own = candidates(text)
        base = [f for f in own if f[2] < 3]
        counts.append([sum(f[2] == k for f in base) for k in range(3)])
        digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
        found += own
        passages += [hashlib.sha256(text[max(0, s - AROUND) : e + AROUND].encode()).digest()[:16] for s, e, _, _ in own]
        sizes.append(len(own))
    counts = np.array(counts, np.int64)
    starts, ends, kinds, values = zip(*found, strict=True) if found else ((), (), (), ())
    struct = pa.StructArray.from_arrays(
        [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.int32()), pa.array([hashlib.sha256(v.encode()).digest()[:16] for v in values], pa.binary()), pa.array(passages, pa.binary())],
        ["start", "end", "kind", "hash", "passage"],
    )
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("mark"), batch.column("owner"), batch.column("repository"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests), lists(struct, np.array(sizes))],
        ["doc_id", "mark", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners, n_texts, n_passages, spread) of rows (hash, owner, repository, mark, passage)."""
    number = lambda c: found.groupBy("hash", c).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias(f"n_{c}s"))
    by_owner = (
        found.groupBy("hash", "owner").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("mark").alias("texts"))
        .groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("texts").alias("most"))
    )
    # the owner of the most texts, and one more for each text that this one does not hold
    spread = F.least("n_owners", F.col("n_texts") - F.col("most") + 1).alias("spread")
    return by_owner.join(number("mark").withColumnRenamed("n_marks", "n_texts"), "hash").join(number("passage"), "hash").select(
        "hash", "n_repositories", "n_owners", "n_texts", "n_passages", spread
    )


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", owner_limit: int = OWNER_LIMIT) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, findings.

    findings: start, end, kind, n_owners, n_repositories, live, of each reported span. `mark` is a hash of the text.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), name(owner).alias("owner"), name(repository).alias("repository"),
    ).withColumn("mark", F.xxhash64("text"))
    rows = source.mapInArrow(
        by_batch(_find),
        "doc_id long, mark long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "found array<struct<start:int,end:int,kind:int,hash:binary,passage:binary>>",
    )
    # small rows without the text; kept so that texts are scanned once and each row has a lasting number
    rows = checkpointed(rows).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "mark", "owner", "repository", F.explode("found").alias("f")).select("row", "mark", "owner", "repository", "f.*")
    told = (F.col("kind") < 3) | (F.col("n_passages") == 1)
    live = (F.col("spread") <= owner_limit) | (told & (F.col("n_texts") <= HANDFUL))
    reported = (
        each.select("row", "start", "end", "kind", "hash").join(ownership(each), "hash").where((F.col("kind") < 3) | live)
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories", live.alias("live")))).alias("findings"))
    )
    shown = F.transform("findings", lambda f: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), f["kind"] + 1), F.lit(":"), f["start"], F.lit(":"), f["end"]))
    return (
        rows.drop("found", "owner", "repository").join(reported, "row", "left")
        .withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<start:int,kind:int,end:int,n_owners:long,n_repositories:long,live:boolean>>")))
        .select(
            "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.concat_ws(",", shown).alias("spans"),
            F.size(F.filter("findings", lambda f: f["live"])).cast("long").alias("n_live"),
            F.size(F.filter("findings", lambda f: ~f["live"])).cast("long").alias("n_example"), "findings", "mark",
        )
    )


MASK = "[secret]"


def masked(text: str, starts: list[int], ends: list[int]) -> str:
    """The text with each span replaced by `MASK`, overlapping spans as one; spans come by start."""
    out, at = [], 0
    for start, end in zip(starts, ends, strict=True):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _masked(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([t if s is None else masked(t, s, e) for t, s, e in zip(text, starts, ends, strict=True)], dtype=object)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with every live span of `scan` replaced by `MASK`; other texts, nulls included, stay as they are."""
    spans = (
        found.select("doc_id", "mark", F.filter("findings", lambda f: f["live"]).alias("live")).where(F.size("live") > 0)
        .dropDuplicates(["doc_id", "mark"]).select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "live")
    )
    joined = whole_rows(docs).join(spans, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_mark") == F.col("hit_mark")), "left")
    # texts without spans do not go to Python
    own = F.col("row")["text"]
    cut = _masked(F.when(F.col("live").isNotNull(), own), F.col("live.start"), F.col("live.end"))
    text = F.when(F.col("live").isNull(), own).otherwise(cut)
    return joined.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
