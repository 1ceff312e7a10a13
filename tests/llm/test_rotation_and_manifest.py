"""Block rotation and the Merkle manifest against plain versions, on given and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vitrine.llm import block_rotation, merkle_manifest, queries
from vitrine.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, output string, form string, pos long, tree string, block string"
SMALL = "/root/testdata/sf0.001"


def awkward():
    rng = random.Random(3)
    lines = lambda n: "".join(rng.choice(["a b", "ä", "", "x<y", "你好", "<", "P>"]) + "\n" for _ in range(n))
    texts = ["", None, "\n", "a", "a\n", "\n\n\n", "no end\nof line", "has <S> inside\nx", "<P>", "<\nP>", "<<\nS>\n<M\n>", "é\r\nü\n", lines(40), lines(40), lines(3000), "z" * 200_000 + "\n" + "y" * 70_001]
    langs = [None, "", "en", "de", "é"]
    rows = [(i, t, langs[i % 5], [None, "s"][i % 2], [None, 3, 2**62][i % 3]) for i, t in enumerate(texts * 3)]
    rows += [(None, "k", "en", "s", 1), (None, None, None, None, None), (7, "again", "en", "s", 1), (7, "again", "en", "s", 1), (7, "other", "en", "s", 1), (-5, "minus", "lone", None, 5)]
    rows += [(100 + i, f"t{i}", "many", "s", i) for i in range(70)]
    return [(*r, "o", "psm", 9, "t", "b") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module", params=["odd", "small"])
def docs(request, odd, spark):
    return odd if request.param == "odd" else table(spark, SMALL, "documents")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_middle(doc_id, text, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hashed = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(hashed[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 0)])
def test_middles(docs, rate, spm):
    made = block_rotation.restore(block_rotation.transform(docs, rate=rate, spm=spm)).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made) == Counter(plain_middle(*t, rate, spm) for t in texts)
    assert Counter((r.doc_id, r.restored) for r in made) == Counter(texts)


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_rotations(monkeypatch, chunk):
    monkeypatch.setattr(block_rotation, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        lo, mid, hi = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        buffer = bytearray(data)
        block_rotation.rotate(buffer, lo, mid, hi)
        assert bytes(buffer) == data[:lo] + data[mid:hi] + data[lo:mid] + data[hi:]


def test_restore_of_nulls(spark):
    rows = spark.createDataFrame([(1, None, "psm"), (2, "x", None), (3, "x", "plain")], "doc_id long, output string, form string")
    assert [(r.doc_id, r.restored) for r in block_rotation.restore(rows).orderBy("doc_id").collect()] == [(1, None), (2, None), (3, "x")]


def plain_tree(nodes):
    """Root and, per leaf, [(sibling stands left, sibling or None)] level by level."""
    proofs, places, row = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(row) > 1:
        for leaf, at in enumerate(places):
            proofs[leaf].append(((at ^ 1) < at, row[at ^ 1] if at ^ 1 < len(row) else None))
        row = [sha("".join(row[i : i + 2])) for i in range(0, len(row), 2)]
        places = [at // 2 for at in places]
    return row[0], proofs


def plain_fold(node, proof):
    for left, beside in proof:
        node = sha(node) if beside is None else sha(beside + node) if left else sha(node + beside)
    return node


def plain_leaf(row, more):
    parts = []
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        value = row[name]
        if value is not None and name == "n_chars":
            value += more
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha("".join(parts))


def plain_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row["lang"]].append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, 0)))
    grown = {lang: plain_tree([plain_leaf(r, 0) for r in trees[lang]]) for lang in langs}
    root, above = plain_tree([grown[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for row, proof in zip(trees[lang], grown[lang][1], strict=True):
            path = proof + above[k]
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            folded = plain_fold(plain_leaf(row, int(tampered)), path)
            out.append((row["doc_id"], plain_leaf(row, 0), grown[lang][0], root, sha("".join(d for _, d in path if d)), folded, folded == root))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 2, merkle_manifest.LEVELS])
def test_manifest(docs, levels, spark):
    made = merkle_manifest.manifest(merkle_manifest.document_leaves(docs), levels).collect()
    want = plain_manifest([r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, sha("".join(r.proof)), r.folded_root, r.verified) for r in made) == want
    assert {r.verified for r in made} == {True, False}
    assert all((r.n_copied > 0) == (not r.verified) or r.subroot == r.leaf for r in made)


def test_versions_share_untouched_nodes():
    leaves = [sha(str(i)) for i in range(13)]
    tree = merkle_manifest.Tree(leaves, 4)
    before, root = list(tree.nodes), tree.root
    for pos in range(13):
        size = len(tree.nodes)
        version = tree.version(pos, sha("other"))
        assert tree.nodes[: len(before)] == before and tree.root == root
        assert len(tree.nodes) - size == 5  # the leaf and its four ancestors
        assert tree.nodes[version] == plain_tree(leaves[:pos] + [sha("other")] + leaves[pos + 1 :])[0]


@pytest.mark.parametrize("name", ["op11_block_rotation", "op12_merkle_manifest"])
def test_empty(spark, name, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
