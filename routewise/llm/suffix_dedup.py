"""Repeated byte strings by suffix arrays built with two-stage sorting.

Anchors bring equal strings together: the anchor of a string of LENGTH bytes
is the place of its smallest GRAM-byte hash (the leftmost, if tied), so equal
strings have equal anchors at equal places. The starts that share an anchor
form a run; the run's piece of text holds their strings whole. Runs whose anchor
occurs once in the corpus are done. Of the others, equal pieces beyond the
second say nothing more, so at most two of each are sent to the anchor's
partition, where a suffix array of the pieces is built:

* suffixes smaller than their successors are sorted directly,
* the others are induced from them by scanning the buckets of first bytes,
* adjacent common prefixes of LENGTH bytes mark the starts that repeat.

The pieces of an anchor that occurs very often (a common sentence in many contexts)
are cut again into short blocks of starts, keyed by the bytes that all their
strings share. Equal blocks are combined by a hash before any bytes are sent, so
at most two of each go to a suffix array; where the different blocks of a key are
still too many (the edge of the sentence in every context), single starts are
counted by a hash of their strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from routewise.session import cut_lineage

from .common import BYTE_CODE, byte_values, flat_bytes, list_array, mix64, span_hashes, text_slices

LENGTH = 400
GRAM = 32
SLICE_BYTES = 1 << 20
#: Bytes of pieces in one suffix array (the pieces of one anchor that is not hot may
#: exceed it, by a few MB at most).
BLOCK_BYTES = 1 << 20
#: The pieces of an anchor with more runs are cut into blocks of so many starts.
HOT_PIECES = 2048
HOT_BLOCK = 32


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place (size a power of two)."""
    h, width = BYTE_CODE[data], 1
    while width < size:
        h = mix64(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]) if len(h) > width \
            else h[:0]
        width *= 2
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each window of ``width`` hashes."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(back[:n - width + 1], ahead[width - 1:n])
    # Candidates are places of block minima; a window's leftmost minimum is the
    # first place at or after its start that holds its smallest value.
    first = np.flatnonzero(np.append(True, smallest[1:] != smallest[:-1]))
    out = np.empty(len(smallest), np.int64)
    stops = np.append(first[1:], len(smallest))
    for a, b in zip(first, stops):
        at = a + int(np.argmax(h[a:a + width] == smallest[a]))
        while b > a:
            upto = min(b, at + 1)
            out[a:upto] = at
            a = upto
            if a < b:
                at = a + int(np.argmax(h[a:a + width] == smallest[a]))
    return out


def anchor_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first start, last start) of each run of a text."""
    h = gram_hashes(data, GRAM)
    at = window_minima(h, length - GRAM + 1)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], at[first], first, last


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, anchor, piece, place) of each text, one array entry for each run;
    k1 and k2 name the row, ``piece`` is a hash of the piece's bytes and the
    anchor's place in it, ``place`` holds the first start (upper half), the
    anchor's distance from it and the last start's (16 bits each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            data, offsets = flat_bytes(part.column("text"))
            sizes = np.diff(offsets)
            rows = np.flatnonzero(sizes >= length)
            if not len(rows):
                continue
            columns: list[list[np.ndarray]] = [[] for _ in range(3)]
            for i in rows:
                text = data[offsets[i]:offsets[i + 1]]
                anchor, at, first, last = anchor_runs(text, length)
                piece = mix64(span_hashes(text, first, last + length) + (at - first).astype(np.uint64))
                place = first << 32 | at - first << 16 | last - first
                for c, v in zip(columns, (anchor.view(np.int64), piece.view(np.int64), place)):
                    c.append(v)
            counts = np.array([len(v) for v in columns[0]])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("k1").take(take), part.column("k2").take(take),
                 *(list_array(pa.array(np.concatenate(c)), counts) for c in columns)],
                ["k1", "k2", "anchor", "piece", "place"])

    return docs.select("k1", "k2", "text").mapInArrow(
        run, "k1 long, k2 long, anchor array<long>, piece array<long>, place array<long>")


# --- two-stage suffix sorting ---------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number (zeros at the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(data)]
    return out


def _direct_sort(places: np.ndarray, words: np.ndarray, depth: int, same: np.ndarray) -> np.ndarray:
    """``places`` ordered by the first ``depth`` bytes from each, eight at a time.
    ``same`` numbers equal strings of ``depth`` bytes alike, so that places which
    agree to the end are told at once and only one of each goes deeper."""
    limit = len(words) - 1
    key = words[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]).astype(np.int64) \
        if len(places) else np.zeros(0, np.int64)
    # sort by (group, same): equal strings become neighbours
    order = np.lexsort((same[places], group))
    places, group = places[order], group[order]
    mark = same[places]
    fresh = np.append(True, (group[1:] != group[:-1]) | (mark[1:] != mark[:-1]))[:len(places)]
    heads = np.flatnonzero(fresh)
    rank = group[heads].copy()  # order of the distinct strings found so far
    open_ = np.flatnonzero(np.append(False, rank[1:] == rank[:-1])
                           | np.append(rank[1:] == rank[:-1], False)) if len(rank) > 1 else rank[:0]
    perm = np.arange(len(heads))
    at = 8
    while len(open_) and at < depth:
        mine = perm[open_]
        key = words[np.minimum(places[heads[mine]] + at, limit)]
        order = np.lexsort((key, rank[open_]))
        mine, key, old = mine[order], key[order], rank[open_]
        perm[open_] = mine
        new = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))
        # a new rank is the place of its group's first member
        rank[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        tied = np.append(False, ~new[1:]) | np.append(~new[1:], False)
        open_ = open_[tied]
        at += 8
    sizes = np.diff(np.append(heads, len(places)))[perm]
    starts = heads[perm]
    total = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(len(places))
    return places[total]


def two_stage_order(data: np.ndarray, wanted: np.ndarray, stop: np.ndarray, depth: int,
                    same: np.ndarray) -> np.ndarray:
    """The ``wanted`` places (plus those needed to reach them) in the order of
    their suffixes' first ``depth`` bytes at least.

    ``stop`` is the end of each place's piece. A suffix is of type S when it is
    smaller than its successor in the piece, else of type L; a piece ends
    before anything, so its last suffix is of type L."""
    n = len(data)
    bytes_ = data.astype(np.int16)
    following = np.append(bytes_[1:], -1)
    following[stop - 1 == np.arange(n)] = -1
    differs = bytes_ != following
    # the type of a run of equal bytes is decided where the run ends
    turn = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    small = bytes_[turn] < following[turn]

    # needed: wanted places and what follows them up to the next S place (or the end)
    need = wanted.copy()
    ends = np.flatnonzero(small | (stop - 1 == np.arange(n)))
    chain = np.flatnonzero(wanted & ~small)
    if len(chain):
        to = ends[np.searchsorted(ends, chain)]
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, chain, 1)
        np.add.at(step, to + 1, -1)
        need |= np.cumsum(step[:-1]) > 0
    direct = _direct_sort(np.flatnonzero(need & small), _words(data), depth, same)
    first = data[direct] if len(direct) else np.zeros(0, np.uint8)
    cut = np.searchsorted(first, np.arange(257))

    closing = np.flatnonzero(need & ~small & (stop - 1 == np.arange(n)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    by = np.argsort(data[closing], kind="stable")
    closing = closing[by]
    at = np.searchsorted(data[closing], np.arange(257))
    for c in range(256):
        if at[c] < at[c + 1]:
            waiting[c].append(closing[at[c]:at[c + 1]])

    inner = np.zeros(n, bool)  # places whose predecessor is induced
    inner[1:] = need[:-1] & ~small[:-1] & (stop[:-1] == stop[1:])
    out: list[np.ndarray] = []

    def hand_on(places: np.ndarray, bucket: int) -> np.ndarray:
        """Predecessors of ordered suffixes: those of this bucket come back, the
        others wait in theirs."""
        before = places[inner[places]] - 1
        c = data[before]
        same_bucket = before[c == bucket]
        others = before[c > bucket]
        if len(others):
            c = data[others]
            order = np.argsort(c, kind="stable")
            others, c = others[order], c[order]
            edges = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(c))):
                waiting[c[a]].append(others[a:b])
        return same_bucket

    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(found):  # L suffixes, then their predecessors with the same byte
            out.append(found)
            found = hand_on(found, c)
        s = direct[cut[c]:cut[c + 1]]
        if len(s):
            out.append(s)
            hand_on(s, c)
    return np.concatenate(out) if out else direct


def same_strings(data: np.ndarray, length: int) -> np.ndarray:
    """A number for the ``length`` bytes from each place; equal bytes have equal
    numbers, different ones all but surely not (neighbours are compared later).
    Places nearer to the end than that get numbers of their own."""
    n = len(data)
    out = np.arange(n, dtype=np.uint64)
    if n >= length:
        places = np.arange(n - length + 1)
        out[:n - length + 1] = span_hashes(data, places, places + length)
    return out


def repeated_starts(data: np.ndarray, wanted: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``wanted`` places begin a string of ``length`` bytes that
    begins at another wanted place too."""
    order = two_stage_order(data, wanted, stop, length, same_strings(data, length))
    order = order[wanted[order]]
    out = np.zeros(len(data), bool)
    # adjacent common prefixes, eight bytes at a time, up to ``length``
    words = _words(data)
    left, right = order[:-1], order[1:]
    for at in range(0, length - 7, 8):
        keep = words[left + at] == words[right + at]
        left, right = left[keep], right[keep]
    for at in range(length - length % 8, length):
        keep = data[left + at] == data[right + at]
        left, right = left[keep], right[keep]
    out[left] = out[right] = True
    return out


def _cut_pieces(length: int):
    """Pieces of the starts listed for each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            todo = part.column("todo").to_pylist()
            flat = [r for rows in todo for r in rows]
            piece = [text[r["start"]:r["start"] + r["n"] - 1 + length]
                     for text, rows in zip(byte_values(part.column("text")), todo) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["part"] for r in flat], pa.int64()),
                 pa.array([r["piece"] for r in flat], pa.int64()),
                 pa.array([r["n"] for r in flat], pa.int32()),
                 pa.array([r["copies"] for r in flat], pa.int32()), pa.array(piece, pa.binary())],
                ["part", "piece", "n", "copies", "bytes"])
    return run


def _blocks(length: int):
    """Blocks of starts of the hot pieces listed for each text, without bytes:
    ``part`` is a hash of the bytes that all strings of a block share, ``block``
    one of the block's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "text", SLICE_BYTES):
            out: list[tuple] = []
            for k1, k2, text, todo in zip(rows.column("k1").to_pylist(), rows.column("k2").to_pylist(),
                                          byte_values(rows.column("text")), rows.column("todo").to_pylist()):
                for r in todo:
                    first, last, at = r["start"], r["start"] + r["n"] - 1, r["start"] + r["at"]
                    # blocks are aligned by their distance from the anchor
                    for d in range(-(-(at - first) // HOT_BLOCK) * HOT_BLOCK, -1, -HOT_BLOCK):
                        a, b = at - d, at - d + HOT_BLOCK - 1
                        if a > last:
                            continue
                        core = hashlib.blake2b(text[b:a + length], digest_size=8,
                                               salt=d.to_bytes(4, "little"))
                        name = r["part"] ^ int.from_bytes(core.digest(), "little", signed=True)
                        a, b = max(a, first), min(b, last)
                        own = hashlib.blake2b(text[a:b + length], digest_size=8).digest()
                        out.append((k1, k2, r["part"], r["piece"], name,
                                    int.from_bytes(own, "little", signed=True),
                                    a, a - first, b - a + 1, r["copies"]))
            columns = list(zip(*out)) or [()] * 10
            kinds = [pa.int64()] * 6 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["k1", "k2", "anchor", "piece", "part", "block", "start", "shift", "n", "copies"])
    return run


def _starts(length: int):
    """Each start of the blocks listed for each text, with a 128-bit hash of its string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "text", SLICE_BYTES):
            for text, todo in zip(byte_values(rows.column("text")), rows.column("todo").to_pylist()):
                if not todo:
                    continue
                n = np.array([r["n"] for r in todo])
                h = np.frombuffer(b"".join(
                    hashlib.blake2b(text[a:a + length], digest_size=16).digest()
                    for r in todo for a in range(r["start"], r["start"] + r["n"])), np.int64).reshape(-1, 2)
                at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat([r[c] for r in todo], n), pa.int64()) for c in ("part", "piece")),
                     pa.array(at, pa.int32()), pa.array(np.repeat([r["copies"] for r in todo], n), pa.int32()),
                     pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                    ["part", "piece", "at", "copies", "h1", "h2"])
    return run


def _sort_pieces(length: int):
    """Repeated starts of each piece, from suffix arrays of blocks of pieces. A
    partition comes sorted by ``part``; blocks end between parts."""
    def blocks(batches):
        held, size = [], 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for small in text_slices(iter(rows.to_batches()), "bytes", BLOCK_BYTES):
                held.append(small)
                size += small.column("bytes").nbytes
                if size >= BLOCK_BYTES:
                    t = pa.Table.from_batches(held)
                    part = t["part"].to_numpy()
                    cut = int(np.searchsorted(part, part[-1]))
                    if cut:
                        yield t.slice(0, cut)
                        held = t.slice(cut).combine_chunks().to_batches()
                        size = sum(b.column("bytes").nbytes for b in held)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            t = t.take(np.repeat(np.arange(t.num_rows), t["copies"].to_numpy()))
            data, offsets = flat_bytes(t["bytes"])
            sizes = np.diff(offsets)
            stop = np.repeat(offsets[1:], sizes)
            starts = offsets[:-1]
            n = t["n"].to_numpy().astype(np.int64)
            wanted = np.zeros(len(data), bool)
            wanted[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = True
            hit = np.flatnonzero(repeated_starts(data, wanted, stop, length))
            if not len(hit):
                continue
            # runs of neighbouring repeated starts
            row = np.searchsorted(starts, hit, side="right") - 1
            fresh = np.append(True, (hit[1:] != hit[:-1] + 1) | (row[1:] != row[:-1]))
            a = hit[fresh]
            b = hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)]
            row = row[fresh]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t["part"].to_numpy()[row]), pa.array(t["piece"].to_numpy()[row]),
                 pa.array(a - starts[row], pa.int32()), pa.array(b - starts[row], pa.int32())],
                ["part", "piece", "from", "to"])

    return run


def _remove(length: int):
    """Texts without the bytes of the listed repeated starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            spans, kept = [], []
            for text, found in zip(byte_values(part.column("text")), part.column("found").to_pylist()):
                merged: list[list[int]] = []
                for s in sorted((s["from"], s["to"] + length) for s in found or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(e for m in merged for e in m), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append(merged)
            flat = np.array([m for s in spans for m in s], np.int64).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays(
                [pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32())], ["start", "stop"])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), list_array(pairs, np.array([len(s) for s in spans])),
                 pa.array(kept, pa.binary())], ["row", "removed", "kept"])
    return run


def _todo(docs: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """Texts with the list ``todo`` of their ``rows`` (k1, k2, part, piece, start, n, copies)."""
    listed = rows.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("part", "piece", "start", "n", "copies", *more)).alias("todo"))
    return docs.select("k1", "k2", "text").join(listed.hint("shuffle_hash"), ["k1", "k2"])


def _sorted_marks(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(part, piece, from, to): runs of repeated starts of the listed pieces."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = _todo(docs, rows).mapInArrow(
        _cut_pieces(length), "part long, piece long, n int, copies int, bytes binary")
    return cut.repartition(n, "part").sortWithinPartitions("part").mapInArrow(
        _sort_pieces(length), "part long, piece long, from int, to int").distinct()


def _hot_blocks(docs: DataFrame, pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the pieces of hot anchors, and their kinds: equal blocks combined,
    with one place and at most two copies of each. ``split`` marks the kinds of a
    part with more than BLOCK_BYTES of them; a part of one block has nothing to
    compare and is left out."""
    blocks = _todo(docs, pieces, "at").mapInArrow(
        _blocks(length), "k1 long, k2 long, anchor long, piece long, part long, block long, "
                         "start int, shift int, n int, copies int")
    kinds = blocks.groupBy("part", "block").agg(
        F.sum("copies").alias("total"), F.min(F.struct("k1", "k2", "start", "n")).alias("of"))
    size = kinds.groupBy("part").agg(
        F.sum("total").alias("all"),
        F.sum(F.least("total", F.lit(2)) * (F.col("of.n") + length - 1)).alias("size"))
    kinds = kinds.join(size.where("all > 1"), "part").select(
        "of.k1", "of.k2", "part", F.col("block").alias("piece"), "of.start", "of.n",
        F.least("total", F.lit(2)).cast("int").alias("copies"), (F.col("size") > BLOCK_BYTES).alias("split"))
    return blocks, kinds


def _start_marks(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(part, piece, from, to): repeated single starts of the listed pieces,
    counted by the hash of their strings."""
    starts = _todo(docs, rows).mapInArrow(
        _starts(length), "part long, piece long, at int, copies int, h1 long, h2 long")
    again = starts.groupBy("h1", "h2").agg(F.sum("copies").alias("total")).where("total > 1")
    return starts.join(again, ["h1", "h2"]).select(
        "part", "piece", F.col("at").alias("from"), F.col("at").alias("to")).distinct()


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id",
                   length: int = LENGTH) -> DataFrame:
    """(row: struct of the document's other columns, removed: array of (start,
    stop), kept binary): every byte covered by a string of ``length`` bytes that also
    starts anywhere else in the table, same text included, is removed; all
    judged on the input. Null texts are empty; repeated rows are documents of
    their own and so repeat each other. ``length`` is at least 2 * GRAM and below 2^16."""
    if not 2 * GRAM <= length < 1 << 16:
        raise ValueError(f"length must be from {2 * GRAM} to {(1 << 16) - 1}")
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    docs = docs.select(F.struct(*rest).alias("row"), F.coalesce(text, F.lit("")).alias("text"),
                       F.xxhash64(key, text).alias("k1"), F.xxhash64(text, key).alias("k2"))
    each = cut_lineage(runs(docs, length)).select(
        "k1", "k2", F.inline(F.arrays_zip("anchor", "piece", "place")))
    again = each.groupBy("anchor").agg(F.count("*").alias("total")).where("total > 1")
    found = cut_lineage(each.join(again.select("anchor", (F.col("total") > HOT_PIECES).alias("hot")), "anchor"))

    def pieces(rows: DataFrame) -> DataFrame:  # the different ones of each anchor: how often, and where first
        return rows.groupBy("anchor", "piece").agg(
            F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("of")).select(
            "of.k1", "of.k2", F.col("anchor").alias("part"), "piece",
            F.shiftright("of.place", 32).cast("int").alias("start"),
            (F.col("of.place").bitwiseAND(0xFFFF) + 1).cast("int").alias("n"),
            F.least("n", F.lit(2)).cast("int").alias("copies"),
            F.shiftright("of.place", 16).bitwiseAND(0xFFFF).cast("int").alias("at"))

    send, hot = pieces(found.where("not hot")).drop("at"), found.where("hot")
    if hot.isEmpty():
        marked = cut_lineage(_sorted_marks(docs, send, length))
    else:
        # marks and blocks are kept as one table: in one plan they share the exchange of the texts
        blocks, kinds = _hot_blocks(docs, pieces(hot), length)
        marked = _sorted_marks(docs, send.unionByName(kinds.where("not split").drop("split")), length)
        marked = marked.unionByName(_start_marks(docs, kinds.where("split"), length))
        told = cut_lineage(marked.unionByName(
            blocks.select("part", "block", "anchor", "piece", "shift"), allowMissingColumns=True))
        marked = told.where("shift is null").select("part", "piece", "from", "to")
        of_block = told.where("shift is not null").drop("from", "to").join(
            marked.withColumnRenamed("piece", "block"), ["part", "block"]).select(
            F.col("anchor").alias("part"), "piece", (F.col("shift") + F.col("from")).alias("from"),
            (F.col("shift") + F.col("to")).alias("to")).distinct()
        marked = marked.unionByName(of_block)
    marked = marked.withColumnRenamed("part", "anchor")
    first = F.shiftright("place", 32).cast("int").alias("first")
    spans = found.select("k1", "k2", "anchor", "piece", first).join(marked, ["anchor", "piece"]) \
        .groupBy("k1", "k2").agg(F.collect_set(F.struct(
            (F.col("first") + F.col("from")).alias("from"),
            (F.col("first") + F.col("to")).alias("to"))).alias("found")).hint("shuffle_hash")
    joined = docs.join(spans, ["k1", "k2"], "left").select("row", "text", "found")
    pair = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    return joined.mapInArrow(_remove(length), T.StructType([
        T.StructField("row", docs.schema["row"].dataType),
        T.StructField("removed", T.ArrayType(pair)), T.StructField("kept", T.BinaryType())]))


def report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and runs, digest of what is kept."""
    out = remove_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s.stop - s.start)
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
