"""The pipeline's stages against plain versions, on the smallest tables with awkward rows added."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def sets_of(rows):
    out = {}
    for r in rows:
        w = words_of(r.text)
        n = min(5, len(w))
        out[r.doc_id] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return out


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_stages(spark, tmp_path):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit(1))
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    more = [(9001, None), (9002, ""), (9003, "?! 12"), (9004, "the password = owneronly99 and the rest of the text")]
    more = spark.createDataFrame([(i, t, "en", "own", 1, 1) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long, score int")
    docs = given.unionByName(more).repartition(3)
    seen = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if number < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append(docs.collect())
    told, single, clean, masked, pieces = seen
    ids = lambda rows: {r.doc_id for r in rows}
    assert not ids(told) & {9001, 9002, 9003} and 9004 in ids(told) and len(told) >= 0.98 * given.count()
    sets = sets_of(told)
    linked = {(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    root = {i: i for i in sets}
    for _ in sets:
        before = dict(root)
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert ids(single) == {i for i in sets if root[i] == i} and len(single) == len(ids(single))
    windows = {tuple(w[k : k + 10]) for w in map(folded, items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = {r.doc_id for r in single if any(tuple(w[k : k + n]) in windows for w in [folded(r.text)] for n in sizes for k in range(len(w) - n + 1))}
    assert hit and ids(clean) == ids(single) - hit
    assert ids(masked) == ids(clean)
    text = {r.doc_id: r.text for r in masked}
    assert text[9004] == "the [secret] and the rest of the text"
    assert all(r.n_chars == len(r.text) for r in masked)
    plain = {r.doc_id for r in clean if not re.search(r"(?i)(password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}", r.text)}
    assert all(text[r.doc_id] == r.text for r in clean if r.doc_id in plain)
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert tokens == Counter({p.doc_id: p.doc_tokens for p in pieces}) and set(tokens) == ids(masked)
