"""The registered queries of the operators, each over its whole tables, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.llm import (
    block_rotation,
    chosen_path,
    context_tree,
    decontamination,
    harmonic_packing,
    hash_tree,
    language_mixture,
    licence_digest,
    media_columns,
    merkle_manifest,
    rlz_dedup,
    secret_ownership,
    suffix_dedup,
)
from vitrine.llm.common import LOWER, UPPER, id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _canonical(text: str) -> str:
    """The canonical form of a text as DuckDB SQL, step by step as the operator states it."""
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, '(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
    out = f"' ' || regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g') || ' '"
    for word, same in licence_digest.SPELLINGS:
        out = f"replace({out}, ' {word} ', ' {same} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


LICENCE_TWIN = f"""
WITH known AS (SELECT sha256(form) AS digest, min(licence) AS licence FROM (
  SELECT licence, {_canonical('text')} AS form FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licence_digest.KNOWN)}) v(licence, text))
  WHERE form <> '' GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, sha256({_canonical('line')}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
n AS (SELECT r, count(*) AS n_lines, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM l JOIN known USING (digest) GROUP BY r),
w AS (SELECT r, doc_id, sha256({_canonical('text')}) AS canonical_sha256 FROM d)
SELECT w.doc_id, w.canonical_sha256, k.licence AS text_licence, coalesce(n.n_lines, 0) AS n_lines, coalesce(n.licences, '') AS licences
FROM w LEFT JOIN known k ON k.digest = w.canonical_sha256 LEFT JOIN n ON n.r = w.r"""

_WORDS = (
    f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
)
_WIDTH = decontamination.WIDTH
DECONTAMINATION_TWIN = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT item, w, least(len(w), {_WIDTH}) AS size, unnest(range(1, len(w) - least(len(w), {_WIDTH}) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM p),
d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT t.r, t.i, t.size, windows.item FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM places) t JOIN windows USING (size, words)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS j FROM hits) GROUP BY r),
listed AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)"""

_HEADS = ", ".join(f"CAST('0x' || substr(hash, {8 * i + 1}, 8) AS UBIGINT) AS h{i + 1}" for i in range(4))
_OUTPUTS = (
    "CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle "
    "ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END"
)
ROTATION_TWIN = f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('{block_rotation.SEED}:' || coalesce(CAST(CAST(doc_id AS BIGINT) AS VARCHAR), '')) AS hash FROM documents),
u AS (SELECT doc_id, text, {_HEADS}, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
p AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {block_rotation.RATE} THEN 'plain'
    WHEN h4 % 100 < {block_rotation.SPM} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256({_OUTPUTS}) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(more: int) -> str:
    return "sha256(" + " || ".join(_field(f"(CAST({c} AS HUGEINT) + {more})" if c == "n_chars" and more else c) for c in merkle_manifest.FIELDS) + ")"


#: CRC-32 of a short ASCII text, bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT))), "
    "lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
)
_STEP = """sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, ''), f.steps + 1"""
_BESIDE = "s.tree = f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1)"
MANIFEST_TWIN = f"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce('=' || lang, '') AS tree, {_leaf(0)} AS leaf,
  CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {_CRC.format("CAST(doc_id AS VARCHAR)")} % {merkle_manifest.TAMPERED} = 0 THEN {_leaf(1)} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM d),
nodes AS (SELECT tree, 0 AS level, pos, total, leaf AS h FROM l
  UNION ALL SELECT tree, level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE total > 1 GROUP BY tree, level, pos // 2, total),
subroots AS (SELECT tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total FROM nodes WHERE total = 1),
forest AS (SELECT '' AS tree, 0 AS level, pos, total, h FROM subroots
  UNION ALL SELECT tree, level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM forest WHERE total > 1 GROUP BY tree, level, pos // 2, total),
low AS (SELECT row_number() OVER () AS r, doc_id, leaf, changed, tree, 0 AS level, pos, total, coalesce(changed, leaf) AS h, '' AS proof, 0 AS steps FROM l),
up AS (SELECT * FROM low UNION ALL SELECT f.r, f.doc_id, f.leaf, f.changed, f.tree, f.level + 1, f.pos // 2, (f.total + 1) // 2, {_STEP}
  FROM up f LEFT JOIN nodes s ON {_BESIDE} WHERE f.total > 1),
high AS (SELECT u.r, u.doc_id, u.leaf, u.changed, b.h AS subroot, '' AS tree, 0 AS level, b.pos, b.total, u.h, u.proof, u.steps FROM up u JOIN subroots b ON b.name = u.tree WHERE u.total = 1),
top AS (SELECT * FROM high UNION ALL SELECT f.r, f.doc_id, f.leaf, f.changed, f.subroot, f.tree, f.level + 1, f.pos // 2, (f.total + 1) // 2, {_STEP}
  FROM top f LEFT JOIN forest s ON {_BESIDE} WHERE f.total > 1),
root AS (SELECT h AS root FROM forest WHERE total = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified, CAST(CASE WHEN changed IS NULL THEN 0 ELSE steps END AS BIGINT) AS n_copied
FROM top, root WHERE total = 1"""


@query("op1_secret_ownership")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership.scan(table(spark, sf_dir, "documents")).drop("findings", "mark")


@query("op2_rlz_dedup")
def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("factors")


@query("op3_harmonic_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing.pack(table(spark, sf_dir, "documents"))


@query("op4_context_tree")
def scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


@query("op5_chosen_path")
def join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_docs")


@query("op6_licence_digest", LICENCE_TWIN)
def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest.scan(table(spark, sf_dir, "documents"), licence_digest.known_texts(spark))


@query("op7_language_mixture")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = language_mixture.fit(docs.where(~held_out).select("text", "lang"))
    return language_mixture.identify(docs, model, F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out")).select(
        "doc_id", "held_out", "lang_pred", "score", F.concat_ws(",", "langs").alias("langs")
    )


@query("op8_hash_tree")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign(table(spark, sf_dir, "documents"))


@query("op9_decontamination", DECONTAMINATION_TWIN)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans", "mark")


@query("op10_media_columns")
def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.store_texts(table(spark, sf_dir, "documents"))


@query("op11_block_rotation", ROTATION_TWIN)
def middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_rotation.restore(block_rotation.transform(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


@query("op12_merkle_manifest", MANIFEST_TWIN)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle_manifest.manifest(merkle_manifest.document_leaves(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", "verified", "n_copied"
    )


@query("op13_suffix_dedup")
def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("spans")
