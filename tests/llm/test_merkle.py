import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from routewise.llm import merkle
from .conftest import make_docs


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                     for v in (doc_id, source, lang, n_chars, text)))


def grow(nodes):
    """(root, proof of each node as a list of (left, right))."""
    proofs = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_below = [], []
        for s in range(0, len(nodes), 16):
            run = nodes[s:s + 16]
            for k in range(len(run)):
                for i in below[s + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h("".join(run)))
            up_below.append(sum(below[s:s + 16], []))
        nodes, below = up, up_below
    return nodes[0], proofs


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda x: x[:3]) for s in sources}
    grown = {s: grow([x[2] for x in trees[s]]) for s in sources}
    root, above = grow([grown[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        subroot, proofs = grown[s]
        for (_, _, node, r), proof in zip(trees[s], proofs):
            steps = proof + up
            name = "" if r[0] is None else str(r[0])
            at = node
            if zlib.crc32(name.encode()) % 5 == 0 and r[4] is not None:
                at = leaf(*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in steps:
                at = h(left + at + right)
            out.append((r[0], node, subroot, root, h("".join(a + b for a, b in steps)), at, at == root))
    return sorted(out, key=str)


def rows_of(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


def check(docs, **how):
    assert sorted((tuple(r) for r in merkle.report(docs, **how).collect()), key=str) == brute(rows_of(docs))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_frontier_witnesses(n):
    nodes = [h(str(i)) for i in range(n)]
    levels = 0
    while 16 ** levels < n:
        levels += 1
    grown = merkle.Frontier(levels)
    for node in nodes:
        grown.append(node)
    root = grown.close()
    want, proofs = grow(nodes)
    assert root == want
    for node, steps, proof in zip(nodes, grown.witness, proofs):
        assert [o for _, o in steps] == [a + b for a, b in proof]
        assert merkle.fold(node, steps) == root and merkle.fold(h("x"), steps) != root


def test_sources_of_many_sizes(spark):
    """Blocks of one level, so trees of up to four rounds."""
    sizes = {"a": 1, "b": 2, "ä": 16, "c": 17, None: 33, "hot": 4500, "": 3, "B": 257}
    rows, ids = [], 0
    for source, n in sizes.items():
        for k in range(n):
            ids += 7
            rows.append((ids * 31 % 100_003, source, None if k % 3 else "en", k, None if k % 50 == 1 else f"Text {k}"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    check(docs, levels=1)


def test_many_sources(spark):
    rows = [(k, f"s{k % 301:03d}", "en", 1, "T") for k in range(700)]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))


def test_odd_rows(spark):
    texts = [None, "", "A", "A", "é" * 50_000, "Long " * 20_000, "x", "x", None, None]
    ids = [None, None, 3, 3, 4, 5, 5, 5, None, 6]
    docs = make_docs(spark, texts, ids=ids, langs=[None] * 10)
    docs = docs.withColumn("LEAF", F.lit(1)).withColumn("tree", F.lit("t")).withColumn("nth", F.lit(0)) \
        .withColumn("source", F.when(F.col("doc_id") > 4, F.lit(None)).otherwise(F.col("source")))
    check(docs)
    check(docs.where("doc_id = 4"))
    assert merkle.report(make_docs(spark, [])).count() == 0
    check(spark.createDataFrame([(None,) * 5] * 40, docs.select(
        "doc_id", "source", "lang", "n_chars", "text").schema))


def test_given_documents(spark, corpus):
    check(corpus)
    got = merkle.report(corpus).where("NOT verified").select("doc_id").collect()
    assert got and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)


def test_manifest_keeps_witness_steps(spark, corpus):
    leaves = corpus.select("doc_id", "source", merkle.leaf_hash(F.col("doc_id")).alias("leaf"))
    for r in merkle.manifest(leaves, payload=("doc_id",)).collect():
        assert merkle.fold(r.leaf, list(zip(r.places, r.others))) == r.root
