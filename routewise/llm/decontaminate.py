"""Benchmark decontamination with a distributed positional inverted index.

The training side is inverted once and stored: tasks cut the texts into slices and
write one posting list a term and slice (the gaps between its positions) beside a
directory of the slice's texts. A frequent term is thereby one bounded list in each
slice, never one long one. The index knows nothing of the benchmark and serves any
number of them.

The test side is a table of windows of terms. Corpus-wide counts from the index order
a window's terms by rarity, and the window is sent to the slices that hold its rarest
term, where that list, shifted back by the term's offset, is intersected with the
shifted lists of the other terms from the rarest up. What remains are exact phrase
matches; with ``slack`` above 0 lists also meet within that many positions of the
same text, which gives proximity matches. Nothing of the benchmark or the corpus
passes through the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from routewise.session import save_table

from .common import byte_values, list_array, opened, sealed, sealed_name, text_slices

WINDOW = 10
#: Bytes of documents in one slice of the index, and of windows searched in it at a time.
SLICE_BYTES = 4 << 20
GROUP_BYTES = 8 << 20
#: Places looked at together while lists are intersected, and windows in one batch.
PLACES = 1 << 20
BATCH_WINDOWS = 1 << 14

#: A-Z lowered; bytes that are no part of a word become spaces.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256))
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: The term of a slice's directory row: no word is empty.
_DIRECTORY = b""
_KEY_BYTES = 16

MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType()), T.StructField("exact", T.BooleanType())])


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def text_key(text: Column) -> Column:
    """128-bit digest of a text: rows of equal text share their matches."""
    return F.unhex(F.md5(text.cast("binary")))


# --- the index of the training side -----------------------------------------

def build_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The stored index: (slice, term, gaps, texts, once). ``gaps`` are the differences
    of the term's positions in the slice, whose texts lie end to end. In the row of the
    empty term they are the texts' lengths in words, and ``texts`` holds the texts' keys
    one after another. Terms that a slice holds once share rows without a ``term``:
    ``once`` lists them with spaces between, ``gaps`` their positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, "text", SLICE_BYTES):
            tokens = [words(t) for t in byte_values(part.column("text"))]
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            if not lengths.any():
                continue
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(tokens)), np.int32, int(lengths.sum()))
            terms = list(numbers)
            sizes = np.bincount(ids)
            places = np.argsort(ids, kind="stable")
            first = np.cumsum(sizes) - sizes
            gaps = np.diff(places, prepend=0)
            gaps[first] = places[first]
            alone = np.flatnonzero(sizes == 1)
            rows, at = [], []
            for low in range(0, len(alone), BATCH_WINDOWS):
                some = alone[low:low + BATCH_WINDOWS]
                line = b" ".join(map(terms.__getitem__, some.tolist()))
                try:
                    line.decode()
                except UnicodeDecodeError:  # stays in rows of its own, byte for byte
                    continue
                rows.append(line)
                at.append(some)
            listed = np.ones(len(terms), bool)
            for some in at:
                listed[some] = False
            kept = np.flatnonzero(listed)
            flat = np.concatenate([gaps[np.repeat(listed, sizes)], lengths, *(gaps[first[x]] for x in at)])
            sizes = np.concatenate([sizes[kept], [len(lengths)], [len(x) for x in at]]).astype(np.int64)
            keys = b"".join(k or bytes(_KEY_BYTES) for k in part.column("key").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), number)),
                 pa.array([terms[k] for k in kept.tolist()] + [_DIRECTORY] + [None] * len(rows), pa.binary()),
                 list_array(pa.array(flat, pa.int32()), sizes),
                 pa.array([None] * len(kept) + [keys] + [None] * len(rows), pa.binary()),
                 pa.array([None] * (len(kept) + 1) + rows, pa.binary())],
                ["slice", "term", "gaps", "texts", "once"])
            number += 1

    column = F.col(f"`{text}`")
    rows = docs.select(column.cast("string").alias("text"), text_key(column).alias("key"))
    return save_table(rows.mapInArrow(
        run, "slice long, term binary, gaps array<int>, texts binary, once binary"))


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored lists (slice, term, gaps, texts) of the given terms (column ``term``)."""
    several = index.where("term is not null").select("slice", "term", "gaps", "texts")
    once = index.where("once is not null").select("slice", F.explode(F.arrays_zip(
        F.split(F.col("once").cast("string"), " ").alias("term"), F.col("gaps").alias("place"))).alias("one")) \
        .select("slice", F.col("one.term").cast("binary").alias("term"), F.col("one.place").alias("place"))
    return several.join(terms, "term", "left_semi").unionByName(
        once.join(terms, "term", "left_semi").select("slice", "term", F.array("place").alias("gaps")),
        allowMissingColumns=True)


# --- the windows of the test side --------------------------------------------

def cut_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, phrase, terms): runs of ``size`` words of each item, or the
    whole of a shorter one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            for item, text in zip(part.column("item_id").to_pylist(), byte_values(part.column("text"))):
                tokens = words(text)
                n = max(1, len(tokens) - size + 1) if tokens else 0
                for at in range(0, n, BATCH_WINDOWS):
                    rows = [tokens[k:k + size] for k in range(at, min(n, at + BATCH_WINDOWS))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(rows), pa.string()),
                         pa.array([b" ".join(r) for r in rows], pa.binary()),
                         pa.array(rows, pa.list_(pa.binary()))], ["item_id", "phrase", "terms"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.col("text").cast("string").alias("text")) \
        .where("item_id is not null and text is not null")
    return items.mapInArrow(run, "item_id string, phrase binary, terms array<binary>").distinct()


def by_rarity(phrases: DataFrame, lists: DataFrame) -> DataFrame:
    """(phrase, lead, places): the rarest term of each phrase and the places of all
    its terms from the rarest up. Phrases with a term that no text holds are gone."""
    counts = lists.groupBy("term").agg(F.sum(F.size("gaps")).alias("count"))
    return phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term")) \
        .join(counts, "term").groupBy("phrase") \
        .agg(F.array_sort(F.collect_list(F.struct("count", "place", "term"))).alias("ranked"),
             F.first("length").alias("length")) \
        .where(F.size("ranked") == F.col("length")) \
        .select("phrase", F.col("ranked")[0]["term"].alias("lead"), F.col("ranked.place").alias("places"))


# --- intersection ---------------------------------------------------------------

@dataclass
class Slice:
    """Posting lists of one slice: keys (term number * width + position), ascending."""
    number: dict[bytes, int]
    keys: np.ndarray
    lists: np.ndarray  # start of each term's keys
    width: int
    begins: np.ndarray  # first position of each text, and the end of the last
    texts: bytes

    @classmethod
    def read(cls, rows: pa.Table) -> Slice:
        terms = rows["term"].to_pylist()
        gaps = rows["gaps"].combine_chunks()
        sizes = gaps.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        flat = gaps.flatten().to_numpy().astype(np.int64)
        at = terms.index(_DIRECTORY)
        begins = np.concatenate([[0], np.cumsum(flat[ends[at] - sizes[at]:ends[at]])])
        reach = np.cumsum(flat)
        place = reach - np.repeat(reach[ends - sizes] - flat[ends - sizes], sizes)
        width = int(begins[-1]) + 1
        listed = np.arange(len(terms)) != at
        term = np.cumsum(listed) - 1
        keep = np.repeat(listed, sizes)
        keys = (np.repeat(term, sizes) * width + place)[keep]
        return cls({t: int(k) for t, k, real in zip(terms, term, listed) if real}, keys,
                   np.concatenate([[0], np.cumsum(sizes[listed])]), width, begins, rows["texts"][at].as_py())


def _table_of(part: Slice, phrases: list[bytes], places: list[list[int]]):
    """(row of the phrase, its term numbers from the rarest up, their offsets), -1
    pads; phrases with a term outside the slice are left out."""
    rows, terms, offsets = [], [], []
    for k, (phrase, order) in enumerate(zip(phrases, places)):
        found = [part.number.get(w, -1) for w in phrase.split(b" ")]
        if -1 not in found:
            rows.append(k)
            terms.append([found[p] for p in order])
            offsets.append(order)
    width = max(map(len, terms), default=1)
    pad = lambda lists: np.array([x + [-1] * (width - len(x)) for x in lists], np.int64).reshape(-1, width)
    return np.array(rows, np.int64), pad(terms), pad(offsets)


def intersect(part: Slice, terms: np.ndarray, offsets: np.ndarray, slack: int) \
        -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, text, place of the window's first word, in the slice) where all terms
    of a window stand within ``slack`` of their place beside its rarest one, in one
    text; the lists of the rarest terms are read in bounded portions."""
    size = np.diff(part.lists)[terms[:, 0]]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, PLACES):
        at = np.arange(low, min(total, low + PLACES))
        window = np.searchsorted(ends, at, side="right")
        lead = terms[window, 0]
        place = part.keys[part.lists[lead] + at - (ends - size)[window]] - lead * part.width
        text = np.searchsorted(part.begins, place, side="right") - 1
        start = place - offsets[window, 0]
        for k in range(1, terms.shape[1]):
            term = terms[window, k]
            wanted = start + offsets[window, k]
            least = np.maximum(wanted - slack, part.begins[text])
            most = np.minimum(wanted + slack, part.begins[text + 1] - 1)
            found = np.searchsorted(part.keys, term * part.width + least)
            key = part.keys[np.minimum(found, len(part.keys) - 1)]
            hit = (term < 0) | ((found < len(part.keys)) & (least <= most)
                                & (key >= term * part.width + least) & (key <= term * part.width + most))
            window, text, start = window[hit], text[hit], start[hit]
        yield window, text, start


def _search(slack: int):
    kinds = [(0, True), (slack, False)] if slack else [(0, True)]

    def run(key: tuple[pa.Scalar, ...], lists: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {"key": [], "phrase": [], "start": [], "stop": [], "exact": []}
        phrases = wanted["phrase"].to_pylist()
        if phrases and lists.num_rows:
            part = Slice.read(lists)
            rows, terms, offsets = _table_of(part, phrases, wanted["places"].to_pylist())
            length = (terms >= 0).sum(axis=1)
            for width, exact in kinds:
                for window, text, start in intersect(part, terms, offsets, width):
                    low, high = part.begins[text], part.begins[text + 1]
                    out["key"] += [part.texts[t:t + _KEY_BYTES] for t in (text * _KEY_BYTES).tolist()]
                    out["phrase"] += [phrases[r] for r in rows[window].tolist()]
                    out["start"].append(np.maximum(start, low) - low)
                    out["stop"].append(np.minimum(start + length[window], high) - low)
                    out["exact"].append(np.full(len(window), exact))
        flat = lambda lists, kind: pa.array(np.concatenate(lists) if lists else [], kind)
        return pa.table({
            "key": pa.array(out["key"], pa.binary()), "phrase": pa.array(out["phrase"], pa.binary()),
            "start": flat(out["start"], pa.int32()), "stop": flat(out["stop"], pa.int32()),
            "exact": flat(out["exact"], pa.bool_())})
    return run


def search_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """(key, matches) of each text with a match: ``matches`` is an array of (item_id,
    start, stop, exact), overlapping or touching spans of an item joined."""
    windows = save_table(cut_windows(benchmark, window))
    size = windows.agg(F.sum(F.octet_length("phrase"))).head()[0] or 0
    groups = int(size // GROUP_BYTES) + 1
    group = F.pmod(F.xxhash64("phrase"), F.lit(groups))
    phrases = windows.select("phrase", "terms").dropDuplicates(["phrase"])
    vocabulary = windows.select(
        F.explode(F.array_append("terms", F.lit(bytearray(_DIRECTORY)))).alias("term")).distinct()
    lists = save_table(postings(index, vocabulary))
    routed = by_rarity(phrases, lists) \
        .join(lists.select(F.col("term").alias("lead"), "slice"), "lead") \
        .select("slice", group.alias("group"), "phrase", "places")
    posted = lists.select(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("group"),
        "term", "gaps", "texts")
    hits = posted.groupBy("slice", "group").cogroup(routed.groupBy("slice", "group")).applyInArrow(
        _search(slack), "key binary, phrase binary, start int, stop int, exact boolean").distinct()
    spans = hits.join(windows.select("phrase", "item_id"), "phrase") \
        .select("key", "item_id", "exact", "start", "stop").distinct()
    along = Window.partitionBy("key", "item_id", "exact").orderBy("start", "stop")
    before = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("fresh", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))) \
        .withColumn("run", F.sum("fresh").over(along)).groupBy("key", "item_id", "exact", "run") \
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("item_id", "start", "stop", "exact"))).alias("matches"))


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                 window: int = WINDOW, slack: int = 0) -> DataFrame:
    """``docs`` with ``n_words`` and ``matches``: array of (item_id, start, stop,
    exact), word positions in the whole text, runs of overlapping windows of an
    item joined. ``exact`` is false for proximity matches (``slack`` > 0 only).

    An item shorter than ``window`` words is one window; items without words,
    and with null id or text, match nothing. A null or empty text has no words.
    Repeated items count once, repeated documents each on their own. Columns named
    ``n_words`` or ``matches`` are replaced."""
    found = save_table(search_index(build_index(docs, text), benchmark, window, slack))
    rows = sealed(docs)
    column = F.col(sealed_name(docs, text))
    rows = rows.withColumn("key", text_key(column)).withColumn(
        "n_words", F.coalesce(F.regexp_count(column, F.lit(_WORD)), F.lit(0)).cast("long"))
    kept = [(k, c) for k, c in enumerate(docs.columns) if c.lower() not in ("n_words", "matches")]
    return rows.join(found, "key", "left").select(
        *[F.col(f"c{k}").alias(c) for k, c in kept], "n_words",
        F.coalesce("matches", F.array().cast(T.ArrayType(MATCH))).alias("matches"))


def hit_words(matches) -> F.Column:
    """Number of words covered by the exact matches."""
    spans = F.array_sort(F.transform(F.filter(matches, lambda m: m.exact),
                                     lambda m: F.struct(m.start, m.stop)))
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans, zero,
        lambda a, m: F.struct(
            F.greatest(a.reach, m.stop).alias("reach"),
            (a.n + F.greatest(F.lit(0), m.stop - F.greatest(a.reach, m.start))).alias("n")),
        lambda a: a.n)


def contaminated_items(matches) -> F.Column:
    return F.array_sort(F.array_distinct(
        F.transform(F.filter(matches, lambda m: m.exact), lambda m: m.item_id)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """The documents without any exact phrase match; columns stay as they are."""
    found = save_table(search_index(build_index(docs, text), benchmark, window))
    rows = sealed(docs).withColumn("key", text_key(F.col(sealed_name(docs, text))))
    return opened(rows.join(found.select("key"), "key", "left_anti"), docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words hit, items found and their digest. Null and empty
    texts have no words, repeated rows are judged alike, an empty table gives an empty
    one, an empty benchmark hits nothing."""
    found = find_matches(docs.select("doc_id", "text"), benchmark)
    items = contaminated_items(F.col("matches"))
    return found.select(
        "doc_id", "n_words", hit_words(F.col("matches")).alias("n_hit"), items.alias("items")
    ).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS l FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS l
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(l[i:i + n - 1], ' ') AS w
  FROM (SELECT item_id, l, least(len(l), 10) AS n, unnest(range(1, len(l) - least(len(l), 10) + 2)) AS i
        FROM b WHERE len(l) > 0)),
gram AS (
  SELECT doc_id, n, i, array_to_string(l[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(l) >= n)),
hit AS (SELECT gram.doc_id, gram.i, gram.n, win.item_id FROM gram JOIN win ON gram.n = win.n AND gram.w = win.w),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
