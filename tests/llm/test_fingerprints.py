import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from routewise.llm import fingerprints as fp
from .conftest import make_docs


def digest(text):
    """The digest, one triplet at a time."""
    data = [255, 255, *text.encode(), 255, 255]
    counts = [0] * fp.BUCKETS
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a + (b << 8) + (c << 16)) * 0x9E3779B1 % 2**32
        h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
        counts[h >> 24] += 1
    ranked = sorted(counts)
    q1, q2, q3 = ranked[63], ranked[127], ranked[191]
    classes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    size = len(text.encode())
    head = [min(255, round(float(8 * np.log2(size + 1)))), 16 * q1 // max(q3, 1), 16 * q2 // max(q3, 1)]
    body = [sum(classes[k + j] << 2 * j for j in range(4)) for k in range(0, 256, 4)]
    return bytes(head + body).hex()


def likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    apart = sum(abs((p >> s & 3) - (q >> s & 3)) for p, q in zip(x[3:], y[3:]) for s in (0, 2, 4, 6))
    apart += min(32, abs(x[0] - y[0]) + 0.5 * (abs(x[1] - y[1]) + abs(x[2] - y[2])))
    return 1 - min(apart, 320) / 320


def brute(rows):
    """rows in their order: (doc_id, text)."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(text) // 3
        edited = text[:len(text) - m] + after[:m]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(text), digest(edited),
                    likeness(digest(text), digest(edited)), likeness(digest(text), digest(after))))
    return out


def got(docs):
    return sorted((tuple(r) for r in fp.report(docs).collect()), key=str)


TEXTS = [None, "", "a", "ab", "abc", "é", "日本語テキスト", "x" * 100_000, "abc " * 9, "the end", "the end"]


def test_report_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "SLICE_BYTES", 100)
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("abcdé \n") for _ in range(r.randint(0, 400))) for _ in range(90)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = sorted(zip(ids, texts), reverse=True, key=lambda x: x[0])
    docs = make_docs(spark, texts, ids=ids).repartition(5)
    assert got(docs.withColumn("part", F.lit(1)).withColumn("FINGERPRINT", F.lit("x"))) == sorted(brute(rows), key=str)


def test_one_document_and_none(spark):
    assert got(make_docs(spark, ["alone"])) == brute([(0, "alone")])
    assert got(make_docs(spark, [None])) == brute([(0, None)])
    assert got(make_docs(spark, [])) == []


def test_repeated_and_null_ids(spark):
    texts, ids = ["a b c d e f"] * 40 + ["u v w"] * 3, [7] * 40 + [None, None, 2]
    out = got(make_docs(spark, texts, ids=ids).repartition(6))
    rows = [(7, "a b c d e f")] * 40 + [(2, "u v w")] + [(None, "u v w")] * 2
    assert out == sorted(brute(rows), key=str)


def test_given_documents(spark, corpus):
    rows = sorted(((r.doc_id, r.text) for r in corpus.collect()), reverse=True)
    assert got(corpus) == sorted(brute(rows), key=str)


def test_edits_are_nearer_than_neighbours(spark, corpus):
    rows = [r for r in fp.report(corpus).collect() if r.n_chars >= 200 and r.near_next < 1]
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.99
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_column_functions(spark):
    docs = make_docs(spark, TEXTS).withColumn("FingerPrint", F.lit(1))
    out = fp.add_fingerprint(docs)
    assert [r.fingerprint for r in out.orderBy("doc_id").collect()] == [digest(t or "") for t in TEXTS]
    assert len(out.columns) == len(docs.columns)
    pairs = out.select("doc_id", F.when(F.col("doc_id") != 3, F.col("fingerprint")).alias("a"),
                       F.lit(digest("abc")).alias("b"))
    found = {r.doc_id: r.s for r in pairs.select("doc_id", fp.likeness(F.col("a"), F.col("b")).alias("s")).collect()}
    assert found == {k: None if k == 3 else likeness(digest(t or ""), digest("abc")) for k, t in enumerate(TEXTS)}


def test_bounds():
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (50, 67)).astype(np.uint8)
    assert (fp.likeness_of(a, a) == 1).all() and (fp.differences(a, a[::-1]) <= fp.BOUND).all()
    zero, full = np.zeros((1, 67), np.uint8), np.full((1, 67), 255, np.uint8)
    assert fp.likeness_of(zero, full)[0] == 0
    empty = fp.bucket_counts(*fp.flat_bytes(pa.array([""])))
    assert empty.sum() == 2
