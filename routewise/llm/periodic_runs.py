"""Maximal periodic runs of words by an enhanced suffix array.

The words of a slice of texts, with a unique mark behind each text, are put into
a suffix array by prefix doubling; the ranks of every doubling step are kept,
since equal ranks say that so many words are equal. Every boundary between two
neighbours of the array with a common prefix of ``depth`` words splits an LCP
interval into two children. The suffixes of the smaller child ask the inverse
array whether their partner ``depth`` words away lies in the other child: if so,
the two are a branching tandem, a square that its next word does not continue.
Squares rotate to the left as far as their words allow, and squares of one
stretch are merged into the run of its smallest period. Intervals are pairs of
numbers in arrays; no tree is built.

A text is the unit of work: slices hold at most SLICE_BYTES of text, a longer
text is a slice of its own. Memory is about 30 bytes for each word, and 4 more
for each doubling step that a repeated stretch needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import flat_bytes, list_array, mix64, span_hashes, text_slices, with_arrays, with_fields, words_of

#: A run has at least this many words, and this many periods.
MIN_LENGTH = 24
MIN_PERIODS = 3
SLICE_BYTES = 1 << 20
#: Suffixes that ask for their partners at a time.
ASKED = 1 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def rank_levels(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by level): two positions have equal ranks at level k
    just when their next 2^k keys are equal. The last level where any two
    positions agree is the last one in the list. The last key must be unique."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    rank = np.empty(len(keys), np.int32)
    rank[order] = start
    levels, step = [], 1
    while not new.all():
        levels.append(rank)
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)  # places whose suffix still ties with a neighbour
        at = order[open_]
        # a suffix that ties has a longer partner, so its text goes on for `step` keys
        key = rank[at].astype(np.int64) * len(keys) + rank[at + step]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new[open_[1:]] = key[1:] != key[:-1]
        new[open_[0]] = True
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        step *= 2
    return order, levels


def common_prefixes(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal keys from positions i and j on (i != j)."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for k in range(len(levels) - 1, -1, -1):
        same = live[levels[k][i[live]] == levels[k][j[live]]]
        n[same] += 1 << k
        i[same] += 1 << k
        j[same] += 1 << k
    return n


def common_suffixes(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal keys before positions i < j."""
    i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        can = np.flatnonzero(i >= 1 << k)
        same = can[levels[k][i[can] - (1 << k)] == levels[k][j[can] - (1 << k)]]
        n[same] += 1 << k
        i[same] -= 1 << k
        j[same] -= 1 << k
    return n


def _nearest(lcp: np.ndarray, at: np.ndarray, side: int, strict: bool) -> np.ndarray:
    """For each place, the next one on a side (-1 or 1) whose value is smaller
    (or, unless ``strict``, equal). Values at both ends are -1. A place whose
    neighbour does not qualify goes on from where that neighbour's search is."""
    found = np.arange(len(lcp)) + side
    found[0 if side < 0 else -1] = 0 if side < 0 else len(lcp) - 1
    open_ = at
    while len(open_):
        value = lcp[found[open_]]
        open_ = open_[value >= lcp[open_] if strict else value > lcp[open_]]
        found[open_] = found[found[open_]]
    return found[at]


def branching_tandems(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, d) of every square of two times d keys at i that the key behind it
    does not continue with period d."""
    n = len(order)
    none = np.zeros(0, np.int64)
    if not levels:
        return none, none
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)  # lcp[r]: of the suffixes at places r - 1 and r
    lcp[1:n] = 0
    tie = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    lcp[tie] = common_prefixes(levels, order[tie - 1], order[tie])
    # children of the interval on both sides of the boundary; the first of equal
    # boundaries is the upper one
    left = _nearest(lcp, tie, -1, strict=False)
    right = _nearest(lcp, tie, 1, strict=True)
    depth = lcp[tie]
    on_left = tie - left <= right - tie
    first, size = np.where(on_left, left, tie), np.where(on_left, tie - left, right - tie)
    low, high = np.where(on_left, tie, left), np.where(on_left, right, tie)  # the larger child
    asked = np.cumsum(size)
    squares, begin = [], 0
    while begin < len(tie):
        stop = max(begin + 1, int(np.searchsorted(asked, (asked[begin - 1] if begin else 0) + ASKED)))
        part = slice(begin, stop)
        of = np.repeat(np.arange(begin, stop), size[part])
        ends = np.cumsum(size[part])
        i = order[first[of] + np.arange(int(ends[-1])) - np.repeat(ends - size[part], size[part])]
        d = depth[of]
        for partner, square in ((i + d, i), (i - d, i - d)):
            ok = np.flatnonzero((partner >= 0) & (partner < n))
            place = inverse[partner[ok]]
            ok = ok[(place >= low[of[ok]]) & (place < high[of[ok]])]
            squares.append((square[ok], d[ok]))
        begin = stop
    return (np.concatenate([s for s, _ in squares]).astype(np.int64),
            np.concatenate([d for _, d in squares]).astype(np.int64))


def runs_of(keys: np.ndarray, min_length: int = MIN_LENGTH,
            min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, ascending. ``min_periods`` is at
    least 2. Keys that occur once end every run, so they may part texts."""
    order, levels = rank_levels(keys)
    i, d = branching_tandems(order, levels)
    by = np.lexsort((d, i + 2 * d))
    i, d = i[by], d[by]
    found = []
    while len(i):  # the shortest square at each end, then those that are not in its run
        end = i + 2 * d
        head = np.append(True, end[1:] != end[:-1])
        start = i[head] - common_suffixes(levels, i[head], i[head] + d[head])
        found.append((start, end[head] - start, d[head]))
        of = np.cumsum(head) - 1
        rest = (d % d[head][of] != 0) | (i < start[of])
        i, d = i[rest], d[rest]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    keep = (length >= min_length) & (length >= min_periods * period)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    # a stretch has one smallest period; its multiples are the same run
    by = np.lexsort((period, length, start))
    one = np.append(True, (np.diff(start[by]) != 0) | (np.diff(length[by]) != 0)) if len(by) else by.astype(bool)
    kept = np.sort(by[one])
    return start[kept], length[kept], period[kept]


def _slice_runs(column: pa.Array, min_length: int, min_periods: int):
    """(raw bytes, word starts, word stops, words of each text, runs of each text
    as [text, start, length, period] with starts counted inside the text)."""
    data, offsets = flat_bytes(column)
    _, starts, stops, counts = words_of(data, offsets)
    word = span_hashes(data, starts, stops)
    text = np.repeat(np.arange(len(counts)), counts)
    # equal words of different texts differ, and a mark of its own ends each text
    keys = np.empty(len(word) + len(counts), np.uint64)
    place = np.arange(len(word)) + text
    keys[place] = mix64(word + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    marks = np.cumsum(counts) + np.arange(len(counts))
    keys[marks] = mix64(~np.arange(len(counts), dtype=np.uint64))
    start, length, period = runs_of(keys, min_length, min_periods)
    of = np.searchsorted(marks, start)
    return data, offsets, starts, stops, counts, of, start - (marks[of] - counts[of]), length, period


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH,
              min_periods: int = MIN_PERIODS) -> DataFrame:
    """``docs`` with ``runs``, the (start, length, period) of every run of words
    of ``text`` by start and period, and ``collapsed``, its words without those
    that a run holds behind its first period, joined by one space.

    Words are what stands between ASCII white space; case matters. A run is a
    stretch with its smallest period, of at least ``min_length`` words and
    ``min_periods`` periods (2 or more), that no neighbouring word continues.
    Null and empty texts have no runs and collapse to the empty text; rows are
    judged one by one, so repeated rows and null ids change nothing; columns
    named like the results are replaced; an empty table gives an empty one."""
    if min_periods < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text, SLICE_BYTES):
            data, offsets, starts, stops, counts, of, start, length, period = _slice_runs(
                part.column(text), min_length, min_periods)
            ahead = np.cumsum(counts) - counts
            step = np.zeros(len(starts) + 1, np.int64)
            np.add.at(step, ahead[of] + start + period, 1)
            np.add.at(step, ahead[of] + start + length, -1)
            kept = np.cumsum(step)[:-1] == 0
            texts = np.repeat(np.arange(len(counts)), counts)
            words = np.flatnonzero(kept)
            # a kept word takes the white space behind it along unless it is its text's last kept one
            spaced = words[:-1][texts[words[1:]] == texts[words[:-1]]]
            edge = np.zeros(len(data) + 1, np.int8)
            np.add.at(edge, starts[words], 1)
            np.add.at(edge, stops[words], -1)
            stays = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            stays[stops[spaced]] = True
            out = data.copy()
            out[stops[spaced]] = 0x20
            sizes = np.zeros(len(data) + 1, np.int64)
            np.cumsum(stays, out=sizes[1:])
            ends = pa.py_buffer(sizes[offsets].astype(np.int64))
            collapsed = pa.Array.from_buffers(pa.large_string(), len(counts),
                                              [None, ends, pa.py_buffer(out[stays])]).cast(pa.string())
            values = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            yield with_arrays(part, runs=list_array(values, np.bincount(of, minlength=len(counts))),
                              collapsed=collapsed)

    return docs.mapInArrow(run, with_fields(docs.schema, ("runs", RUNS), ("collapsed", T.StringType())))


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where each document whose crc32(doc_id as text) is a
    multiple of 10 repeats, from some word on, the words there; a null id counts
    as the empty text. Other texts stay as they are."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(
        F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).alias("w"))
    g = F.floor(F.col("h") / 10)
    placed = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))) \
        .withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8)))
    head = F.slice("w", F.lit(1), F.col("a").cast("int"))
    rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1),
                       lambda k: F.get("w", (F.col("a") + k % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(head, rest), " "))
                         .otherwise(F.col("text")).alias("text"))


def _digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def report(docs: DataFrame) -> DataFrame:
    """Per document, after ``plant``: number of runs, the run of greatest
    exponent, digests of all runs and of the collapsed words. Nulls, repeated
    rows and an empty table are as in ``find_runs``."""
    found = find_runs(plant(docs.select("doc_id", "text")))
    best = F.array_sort("runs", lambda x, y:
                        F.when(x.length * y.period > y.length * x.period, -1)
                        .when(x.length * y.period < y.length * x.period, 1)
                        .when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1))
                        .otherwise(F.signum(x.period - y.period).cast("int")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[
        r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("best", F.get(best, 0)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[k].alias(k) for k in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        _digest(F.array_join(lines, "")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"))


ORACLE = r"""
WITH c AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
z AS (
  SELECT doc_id, w, len(w) AS n,
         xor(list_reduce(flatten(list_transform(range(1, len(s) + 1),
           lambda i: [CAST(ord(s[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
           lambda acc, b: xor(xor(acc, b) >> 1, 3988292384 * (xor(acc, b) & 1)), 4294967295), 4294967295) AS h FROM c),
a AS (SELECT doc_id, w, n, h, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM z),
t AS (SELECT row_number() OVER () AS nth, doc_id, n, w, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
v AS (SELECT nth, n, unnest(range(0, n)) AS i, w, a, p FROM t),
u AS (SELECT nth, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word FROM v),
e AS (SELECT x.nth, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.nth = y.nth AND x.word = y.word AND x.i < y.i),
g AS (SELECT nth, q, i - row_number() OVER (PARTITION BY nth, q ORDER BY i) AS isle, i FROM e),
f AS (SELECT nth, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY nth, q, isle),
r AS (SELECT nth, start, length, min(q) AS period FROM f WHERE length >= greatest(24, 3 * q)
      GROUP BY nth, start, length),
b AS (SELECT nth, start, length, period, row_number() OVER (PARTITION BY nth
        ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r),
l AS (SELECT nth, count(*) AS n_runs,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM r GROUP BY nth),
d AS (SELECT u.nth, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.nth = u.nth AND u.i >= r.start + r.period
                        AND u.i < r.start + r.length) GROUP BY u.nth)
SELECT t.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, CAST(b.length AS BIGINT) AS length, b.period,
       CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(d.kept, '')) AS collapsed_sha256
FROM t LEFT JOIN l ON t.nth = l.nth LEFT JOIN b ON t.nth = b.nth AND b.k = 1 LEFT JOIN d ON t.nth = d.nth
"""
