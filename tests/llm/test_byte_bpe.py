import hashlib

import public_tokenizers
import pytest
import tiktoken

from routewise.llm import byte_bpe
from .conftest import make_docs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {p: i for i, p in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_against_an_independent_encoder(spark, corpus, reference):
    odd = [None, "", "<|endoftext|>", "a" * 5000, "  \n\t  x  ", "naïve Ünïcode 日本語 🙂👩‍👩‍👧", "\x00\x01\x1c",
           "it's we'll 'S 12345 !!??", "x" * 30 + " " * 400, "same", "same"]
    docs = make_docs(spark, odd).unionByName(
        corpus.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", corpus.doc_id + 1000))
    got = {r.doc_id: r for r in byte_bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN).collect()}
    digests = {r.doc_id: r for r in byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    ids = spark.createDataFrame([(k, list(r.token_ids)) for k, r in got.items()], "doc_id long, token_ids array<int>")
    decoded = {r.doc_id: r.decoded for r in byte_bpe.decode_ids(ids, PATH).collect()}
    assert len(got) == docs.count() == len(digests)
    for k, r in got.items():
        want = reference.encode_ordinary(r.text or "")
        assert list(r.token_ids) == want
        d = digests[k]
        assert d.n_tokens == len(want)
        assert d.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert bytes(decoded[k]) == (r.text or "").encode()
        assert d.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_empty_table_and_bad_ids(spark):
    assert byte_bpe.digests(make_docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    df = spark.createDataFrame([([1, 2],), (None,), ([],)], "token_ids array<int>")
    assert sum(r.decoded is not None for r in byte_bpe.decode_ids(df, PATH).collect()) == 3
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode_ids(spark.createDataFrame([([50256],)], "token_ids array<int>"), PATH).collect()


def test_cache_overflow_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    e = byte_bpe.Encoder(byte_bpe.serialise_model(byte_bpe.read_ranks(PATH)), public_tokenizers.PATTERN)
    for t in ("one two three four five", "six seven one two", "one"):
        assert e.encode([t])[0].tolist() == reference.encode_ordinary(t)
