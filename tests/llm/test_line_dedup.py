import hashlib
import random

from pyspark.sql import functions as F

from routewise.llm import line_dedup as ld
from .conftest import make_docs


def key_of_line(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def brute(rows):
    """rows: (doc_id, text); the same rules, line by line."""
    rank = lambda d: (d is None, d or 0)
    key = key_of_line
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10 and (k not in first or rank(d) < rank(first[k])):
                first[k] = d
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def check(spark, texts, ids):
    docs = make_docs(spark, texts, ids=ids)
    assert rows_of(ld.report(docs)) == sorted(brute(list(zip(ids, texts))), key=str)


def test_rules(spark):
    check(spark, ["Hello World line\nshort\n hello world LINE\t", "x\nHELLO WORLD LINE", "short\n\n",
                  None, "", "ÀHELLO wörld\nàhello wörld", "Àhello wörld", "hello world line\nown second line",
                  "hello world line\nown second line", "a different text\nhello world line", "own second line"],
          [5, 3, 1, 2, 9, 10, 11, 12, 12, 12, None])


def test_random_with_hot_lines_and_long_texts(spark):
    r = random.Random(3)
    pool = [f"line number {k}" for k in range(40)] + ["tiny"]
    texts = ["\n".join(["the hot line of all"] * (k % 3 > 0) + [r.choice(pool) for _ in range(r.randint(1, 9))])
             for k in range(300)]
    texts.append("\n".join(f"{r.choice(pool)}" for _ in range(20_000)))
    ids = list(range(len(texts)))
    r.shuffle(ids)
    check(spark, texts, ids)


def test_hot_path_equals_the_plain_one(spark, monkeypatch):
    texts = ["the hot line of all\nline of pair %d" % (k // 2) for k in range(200)]
    want = rows_of(ld.report(make_docs(spark, texts)))
    monkeypatch.setattr(ld, "SAMPLE", 1)  # every line repeated more than 8 times is hot
    assert rows_of(ld.report(make_docs(spark, texts))) == want == sorted(brute(list(enumerate(texts))), key=str)


def test_pipeline_form_empty_table_and_clashes(spark):
    docs = make_docs(spark, ["one line of text\nb", "one line of text\nc", None]) \
        .withColumn("keep", F.lit(7)).withColumn("doc", F.lit("d")).withColumn("TAG", F.lit(1))
    out = ld.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars, r.keep) for r in out.collect()} == {
        0: ("one line of text\nb", 18, 7), 1: ("c", 1, 7), 2: (None, None, 7)}
    assert ld.report(make_docs(spark, [])).count() == 0


def test_plan_has_no_python(spark, corpus):
    plan = ld.report(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
