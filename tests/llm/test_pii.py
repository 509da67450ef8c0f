import hashlib
import re

from hypothesis import given, settings, strategies as st

from routewise.llm import pii
from .conftest import make_docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text)
            if 13 <= len(digits(m.group())) <= 19 and sum(
                (int(c) if k % 2 == 0 else sum(divmod(int(c) * 2, 10)))
                for k, c in enumerate(reversed(digits(m.group())))) % 10 == 0]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


ANCHORS = pii.automaton()


def found(text):
    return [(pii.KINDS[k], a, b) for k, a, b in pii.spans_of(text, ANCHORS)]


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="a1@.+-29 (é4%", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in found(text) if s[0] in pii.BASE_KINDS] == base(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789 -", min_size=10, max_size=60))
def test_cards(text):
    assert [s for s in found(text) if s[0] == "card"] == [s for s in base(text) if s[0] == "card"]


def test_cues_and_schemes():
    t = "IBAN: DE89 3704 0044 0532 0130 00. pay ssn 123-45-6789 or http://me:pw@host.example/x"
    kinds = {k: t[a:b] for k, a, b in found(t) if k not in pii.BASE_KINDS}
    assert kinds == {"account": "123-45-6789", "url": "http://me:pw@host.example"} or \
        [t[a:b] for k, a, b in found(t) if k == "account"] == ["DE89 3704 0044 0532 0130 00", "123-45-6789"]
    assert [t[a:b] for k, a, b in found(t) if k == "account"] == ["DE89 3704 0044 0532 0130 00", "123-45-6789"]
    for clean in ("the account was closed", "iban DE89 3704 0044 0532 0130 01", "ssn 000-12-3456",
                  "accounting 12345678", "http://host.example/a@b"):
        assert not [s for s in found(clean) if s[0] in ("url", "account")], clean


def test_report_and_edge_rows(spark, corpus):
    texts = [None, "", "x" * 300_000 + " a@b.cc", "a@b.cc", "a@b.cc"]
    got = {r.doc_id: r for r in pii.report(make_docs(spark, texts)).collect()}
    assert [got[i].n_email for i in range(5)] == [0, 0, 1, 1, 1]
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    rows = {r.doc_id: r for r in pii.report(corpus).collect()}
    for d in corpus.collect():
        want = base(d.text)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(w[0] == k for w in want) for k in pii.BASE_KINDS)
    assert pii.report(make_docs(spark, [])).count() == 0


def test_redact_and_clashing_column(spark):
    from pyspark.sql import functions as F
    df = make_docs(spark, ["mail a@b.cc now", None]).withColumn("SPANS", F.lit(1))
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out == {0: "mail [email] now", 1: None}
