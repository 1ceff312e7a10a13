"""Language identification by multilingual mixture inference.

Learning: hashed byte trigrams of the labelled texts are counted for each language, by Spark, over all rows. Prediction:
a text is cut into short segments; the likelihood of a segment in a language is the product of its trigrams'
likelihoods; expectation-maximisation over the segments gives the share of each language in the text. Among language
sets, grown greedily from the best single language, the one of highest penalised likelihood is kept.

The model is a table of `BUCKETS` counts a language, whatever the size of the corpus; languages are a closed label set.

Null or letterless text: `und`, score 0. Rows without a label are not learned from. Without any label all texts are
`und`. Ties between languages fall to the larger training share, then to the name. Repeated rows, empty tables, long
texts and further columns need no special care: each row is judged alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import by_batch, lists
from vitrine.llm.wordtape import ranges, slices

BUCKETS = 1 << 16
#: Trigram positions that make one segment.
SEGMENT = 48
#: Pseudo-count of every bucket.
SMOOTHING = 0.5
#: Log-likelihood units that one more language must win, times log(1 + segments).
PENALTY = 3.0
ROUNDS = 12
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte; BUCKETS where none does."""
    n = len(data)
    out = np.full(n, BUCKETS, np.uint32)
    if n < 3:
        return out
    b = _FOLD[data]
    gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    blank = (b == 32).astype(np.uint8)
    out[:-2] = np.where(blank[:-2] + blank[1:-1] + blank[2:] > 1, BUCKETS, (gram * np.uint32(2654435761)) >> np.uint32(16))
    for k in (1, 2):
        last = offsets[1:] - k
        out[last[last >= offsets[:-1]]] = BUCKETS
    return out


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (text, lang); one partial table a task and language, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, table in held.items():
                at = np.flatnonzero(table[:BUCKETS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], ["lang", "bucket", "n"]
                )
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, offsets in slices(batch.column("text")):
                codes = _codes(data, offsets)
                mine = np.array(langs[lo:hi], object)
                for lang in set(langs[lo:hi]):
                    own = np.flatnonzero(mine == lang)
                    if lang not in held:
                        if len(held) >= 64:
                            yield from flush()
                        held[lang] = np.zeros(BUCKETS + 1, np.int64)
                    held[lang] += np.bincount(codes[ranges(offsets[own], offsets[own + 1] - offsets[own])], minlength=BUCKETS + 1)
        yield from flush()

    return labelled.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    #: log-likelihood of each bucket (and 0 for none) by language
    table: np.ndarray
    prior: np.ndarray


def fit(labelled: DataFrame) -> Model:
    """The language models of all rows of (text, lang) that have a label."""
    counts = gram_counts(labelled.where(F.col("lang").isNotNull())).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(names)}
    table = np.full((BUCKETS + 1, len(names)), SMOOTHING, np.float64)
    rows = np.array([number[x] for x in counts.column("lang").to_pylist()], np.int64)
    table[counts.column("bucket").to_numpy(), rows] += counts.column("n").to_numpy()
    total = table[:BUCKETS].sum(0)
    table = np.log(table / total)
    table[BUCKETS] = 0
    return Model(names, table.astype(np.float32), total / total.sum() if names else total)


def _expectation_maximisation(like: np.ndarray, owner: np.ndarray, begins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (texts x languages) and log-likelihoods; like: segments x languages, owner: text of each segment."""
    top = like.max(1)
    scaled = np.exp(like - top[:, None])
    shares = np.full((len(n), like.shape[1]), 1 / like.shape[1])
    for _ in range(ROUNDS):
        joint = scaled * shares[owner]
        joint /= joint.sum(1)[:, None]
        shares = np.add.reduceat(joint, begins, axis=0) / n[:, None]
    return shares, np.add.reduceat(np.log((scaled * shares[owner]).sum(1)) + top, begins)


def _select(like: np.ndarray, base: int, base_score: float) -> tuple[list[int], np.ndarray]:
    """Greedy growth of one text's language set while the penalised likelihood rises."""
    n = len(like)
    fee = PENALTY * np.log1p(n)
    chosen, best, shares = [base], base_score, np.ones(1)
    while len(chosen) < like.shape[1]:
        trials = []
        for lang in sorted(set(range(like.shape[1])) - set(chosen)):
            tried = [*chosen, lang]
            s, score = _expectation_maximisation(like[:, tried], np.zeros(n, np.int64), np.zeros(1, np.int64), np.array([n]))
            trials.append((float(score[0]), -lang, tried, s[0]))
        score, _, tried, s = max(trials, key=lambda t: t[:2])
        if score - fee <= best:
            break
        chosen, best, shares = tried, score, s
    return chosen, shares


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, float]]]:
    """For each text its languages with their shares, largest first."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // SEGMENT))
    owner = np.repeat(np.arange(len(n)), n)
    begins = np.cumsum(n) - n
    like = np.zeros((len(owner), len(model.languages)))
    if len(data):
        within = np.arange(len(owner)) - begins[owner]
        some = sizes[owner] > 0
        at = (offsets[:-1][owner] + within * SEGMENT)[some]
        like[some] = np.add.reduceat(model.table[_codes(data, offsets)], at, axis=0)
    single = np.add.reduceat(like, begins, axis=0)
    favoured = single + 1e-6 * model.prior
    base = favoured.argmax(1)
    shares, score = _expectation_maximisation(like, owner, begins, n)
    alone = single[np.arange(len(n)), base]
    out = [[(int(b), 1.0)] for b in base]
    for i in np.flatnonzero(score - alone > PENALTY * np.log1p(n)):
        chosen, own = _select(like[begins[i] : begins[i] + n[i]], int(base[i]), float(alone[i]))
        out[i] = sorted(zip(chosen, map(float, own), strict=True), key=lambda x: (-x[1], -model.prior[x[0]], x[0]))
    # how much better than the runner-up the leading language explains a text in one language only
    return out


def identify(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The kept columns, and lang_pred, score (share of that language), langs and shares of the selected set."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_letter", F.col("_text").rlike(r"\p{L}"))
    kept = source.columns[:-2]

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        letter = batch.column("_letter").to_pylist()
        found: list[list[tuple[int, float]]] = []
        for lo, hi, data, offsets in slices(batch.column("_text")):
            found += infer(model, data, offsets) if model.languages else [[]] * (hi - lo)
        found = [f if ok else [] for f, ok in zip(found, letter, strict=True)]
        counts = np.array([len(f) for f in found])
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept]
            + [
                pa.array([model.languages[f[0][0]] if f else UNDETERMINED for f in found], pa.string()),
                pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                lists(pa.array([model.languages[k] for f in found for k, _ in f], pa.string()), counts),
                lists(pa.array([s for f in found for _, s in f], pa.float64()), counts),
            ],
            [*kept, "lang_pred", "score", "langs", "shares"],
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    return source.mapInArrow(by_batch(predict), f"{schema}, lang_pred string, score double, langs array<string>, shares array<double>")
