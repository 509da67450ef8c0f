"""Line deduplication with DataFrame functions only.

Every line becomes a row of hashes. Rows are range-partitioned by hash and
sorted by document and position, so the first holder of a line streams past
before all others. Dropped lines come back as one sparse bitmap per document;
texts are never part of the exchange of lines.

A line in a large share of all documents would fill one range: such hashes are
found on a sample of documents (which only decides how they travel), spread
over all ranges, and the first holders of the ranges are combined.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from routewise.session import cut_lineage

#: Shortest key, in code points, that counts as a repeated line.
MIN_KEY = 10
#: Lines in one word of a bitmap (the sign bit stays unused).
WORD = 63
#: One document in so many is looked at for hot hashes; a hash is hot when its
#: sampled lines exceed this share of an average range.
SAMPLE = 64
HOT_SHARE = 0.125


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(" \t\n\v\f\r")),
                       string.ascii_uppercase, string.ascii_lowercase)


def _tag(text: Column) -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.shiftrightunsigned(F.xxhash64(text), 33).cast("int")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 min_key: int = MIN_KEY) -> DataFrame:
    """(doc, tag, n_dropped, keep) of each document that loses lines: ``keep``
    maps the number of a word to the bits of its 63 lines, 1 for kept; words
    without a dropped line are left out. ``tag`` is a hash of the text.

    A line is dropped when its key has at least ``min_key`` code points and a
    document with a smaller id holds it. Null ids rank last, as one document;
    rows that share an id are one document too, so they never drop each
    other's lines; a line repeated inside its first document stays."""
    n = _partitions(docs)
    line = F.posexplode(lines_of(F.col(text))).alias("pos", "line")
    rows = docs.select(F.col(doc_id).alias("doc"), _tag(F.col(text)).alias("tag"), line)
    rows = rows.withColumn("key", key_of(F.col("line"))).where(F.char_length("key") >= min_key)
    rows = cut_lineage(rows.select("doc", "tag", "pos", F.xxhash64("key").alias("h1"),
                                   F.hash("key").alias("h2")))

    sample = rows.where(F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(SAMPLE)) == 0)
    size = sample.count()
    least = max(8, int(size * HOT_SHARE / n))
    # at most n / HOT_SHARE rows
    hot = sample.groupBy("h1", "h2").count().where(F.col("count") > least).select("h1", "h2")
    hot_first = rows.join(F.broadcast(hot), ["h1", "h2"], "left_semi") \
        .groupBy("h1", "h2").agg(F.min("doc").alias("hot_first"), F.lit(True).alias("hot"))

    # the upper 31 bits of the hash, scaled to n ranges of equal width
    upper = F.shiftright("h1", 33) + F.lit(1 << 30)
    at = F.shiftright(upper * F.lit(n), 31)
    salt = F.pmod(F.xxhash64("doc"), F.lit(n))
    rows = rows.join(F.broadcast(hot_first), ["h1", "h2"], "left").withColumn(
        "part", F.when(F.col("hot"), F.pmod(at + salt, F.lit(n))).otherwise(at).cast("int"))
    stream = Window.partitionBy("part", "h1", "h2").orderBy(F.asc_nulls_last("doc"), "pos")
    first = F.coalesce(F.col("hot_first"), F.first("doc").over(stream))
    dropped = rows.repartitionById(n, "part").withColumn("first", first) \
        .where(F.col("first").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("first"))))

    word = F.floor(F.col("pos") / WORD).cast("int").alias("word")
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    words = dropped.select("doc", "tag", "pos", word).repartition(n, "doc", "tag") \
        .groupBy("doc", "tag", "word").agg(F.bit_or(bit).alias("bits"), F.bit_count(F.bit_or(bit)).alias("n"))
    kept = F.lit((1 << WORD) - 1).bitwiseXOR(F.col("bits"))
    return words.groupBy("doc", "tag").agg(
        F.sum("n").cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", kept))).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines joined; a null ``keep`` keeps everything."""
    def stays(_line: Column, pos: Column) -> Column:
        bits = F.try_element_at(keep, F.floor(pos / WORD).cast("int"))
        return F.coalesce(F.getbit(bits, (pos % WORD).cast("int")) == 1, F.lit(True))

    return F.when(keep.isNull(), text).otherwise(
        F.array_join(F.filter(lines_of(text), stays), "\n"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(row: struct of the document's columns, n_dropped, keep)."""
    left = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("l_doc"),
                       _tag(F.col(text)).alias("l_tag"))
    right = bitmaps.hint("shuffle_hash")
    on = F.col("l_doc").eqNullSafe(F.col("doc")) & (F.col("l_tag") == F.col("tag"))
    return left.join(right, on, "left").select("row", "n_dropped", "keep")


def drop_repeated_lines(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents without their dropped lines; ``chars``, if there is such a
    column, follows the text. Null texts stay null, every document stays."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, text=text), text=text)
    new = kept_text(F.col(f"row.{text}"), F.col("keep"))
    out = joined.withColumn("row", F.col("row").withField(text, new))
    if chars in docs.columns:
        out = out.withColumn("row", F.col("row").withField(
            chars, F.char_length(f"row.{text}").cast(docs.schema[chars].dataType)))
    return out.select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """Per document: lines, dropped lines, digest of what is kept."""
    docs = docs.select("doc_id", "text")
    joined = with_bitmaps(docs, keep_bitmaps(docs))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return joined.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(text, F.col("keep")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH line AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) u),
holder AS (SELECT key, min(doc_id) AS first FROM line WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT line.*, coalesce(length(line.key) >= 10 AND line.doc_id > holder.first, false) AS gone
           FROM line LEFT JOIN holder ON line.key = holder.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
