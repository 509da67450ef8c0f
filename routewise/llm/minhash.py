"""Near-duplicate documents by circulant MinHash.

A document is its set of distinct word shingles. One permutation places the
shingles, a second one, shifted circularly by one place for each coordinate,
gives all signature coordinates. Bands of coordinates put documents that may
be alike into buckets; every link is confirmed on full sets.

Documents with equal sets are one node from the start. Buckets chain nodes into
candidate clusters along stars: a node and the first node of its buckets. The
edges of the stars are confirmed first, so a family of near copies costs about
one comparison a node. Only what stays apart inside a cluster is compared
further: its confirmed parts are cut into tiles of bounded size, and a task
counts the shared shingles of one pair of tiles at a time and hands on a
spanning forest of the linked parts, never the pairs; two tiles of one part are
not compared. No link between nodes that share a bucket is left out, and no
bucket or cluster is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from routewise.session import cut_lineage

from .common import flat_bytes, list_array, mix64, span_hashes, text_slices, words_of

WORDS = 4
#: 40 bands of 5 coordinates: a pair at similarity 0.8 shares no band with a
#: chance of (1 - 0.8^5)^40 = 1e-7.
BANDS, ROWS = 40, 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
SLICE_BYTES = 1 << 20
#: Nodes and shingles of one tile of a cluster, and nodes of a star in one task.
TILE_NODES = 1024
TILE_SHINGLES = 400_000
#: A shingle of more nodes is counted by matrix products, one of fewer by its pairs.
FEW = 16

_COMBINE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                    np.uint64)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles of all texts, sorted inside each
    text; their number in each text). A text of fewer words, but not none, has
    its whole sequence as one shingle."""
    data, offsets = flat_bytes(column)
    low, starts, stops, counts = words_of(data, offsets)
    word = span_hashes(low, starts, stops)
    ends = np.cumsum(counts)
    begin = ends - counts
    total = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        total += word[k:k + len(total)] * _COMBINE[k]
    total = mix64(total)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        if counts[i] >= words:
            one = np.unique(total[begin[i]:ends[i] - words + 1])
        else:
            few = word[begin[i]:ends[i]] * _COMBINE[:counts[i]]
            one = mix64(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(counts[i]))
        out.append(one)
        sizes[i] = len(one)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def signatures(shingles: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """(sets, coordinates) of 32-bit minima; all sizes are at least 1."""
    place = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), coordinates), np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        np.subtract(place, np.uint32(k), out=x)  # circular shift by k places
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):  # the second permutation
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) of 64-bit keys; keys of different bands differ."""
    parts = signature.reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _COMBINE[0], parts.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key ^ parts[:, :, r])
    return key


def describe(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, tag, n, node, bands) of each document: size of its set, a digest
    of the set and its band keys (both null for the empty set); ``tag`` is a
    hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            shingles, sizes = shingle_sets(part.column("text"), words)
            full = np.flatnonzero(sizes)
            nodes = np.full(len(sizes), None, dtype=object)
            ends = np.cumsum(sizes)
            for i in full:
                nodes[i] = hashlib.blake2b(shingles[ends[i] - sizes[i]:ends[i]].tobytes(),
                                           digest_size=16).digest()
            keys = np.zeros((0, bands), np.uint64)
            if len(full):
                keys = band_keys(signatures(shingles, sizes[full], bands * rows), bands, rows)
            per_row = list_array(pa.array(keys.ravel().view(np.int64)), np.where(sizes > 0, bands, 0))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tag"), pa.array(sizes),
                 pa.array(nodes.tolist(), pa.binary()), per_row],
                ["doc_id", "tag", "n", "node", "bands"])

    rows_in = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in.mapInArrow(
        run, f"doc_id {kind}, tag long, n long, node binary, bands array<long>")


def shared_counts(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, sets) numbers of shared shingles; the diagonal is not filled."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
    count = np.diff(np.append(starts, len(shingles)))
    flat = []
    for c in range(2, FEW + 1):
        at = starts[count == c]
        for i in range(c if len(at) else 0):  # owners ascend, so pairs have i < j
            for j in range(i + 1, c):
                flat.append(owner[at + i] * n + owner[at + j])
    shared = np.zeros(n * n, np.int64)
    if flat:
        shared += np.bincount(np.concatenate(flat), minlength=n * n)
    shared = shared.reshape(n, n)
    shared += shared.T
    many, many_count = starts[count > FEW], count[count > FEW]
    for k in range(0, len(many), 1024):
        c = many_count[k:k + 1024]
        ends = np.cumsum(c)
        at = np.repeat(many[k:k + 1024] - ends + c, c) + np.arange(int(ends[-1]))
        present = np.zeros((n, len(c)), np.float32)
        present[owner[at], np.repeat(np.arange(len(c)), c)] = 1
        shared += (present @ present.T).astype(np.int64)
    return shared


def linked_parts(shingles: np.ndarray, sizes: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect just the parts that links between their sets connect;
    ``part`` is the part of each set."""
    shared = shared_counts(shingles, sizes)
    near = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    order = np.argsort(part, kind="stable")
    names, starts = np.unique(part[order], return_index=True)
    near = np.logical_or.reduceat(np.logical_or.reduceat(near[order][:, order], starts, axis=0), starts, axis=1)
    np.fill_diagonal(near, False)
    left = np.ones(len(names), bool)
    edges = []
    for root in np.flatnonzero(near.any(axis=1)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & left)
            left[reached] = False
            edges += [(int(names[root]), int(names[x])) for x in reached]
            front = reached
    return edges


def _sets(words: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            shingles, sizes = shingle_sets(part.column("text"), words)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep),
                 pa.array([shingles[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())],
                [*keep, "s"])
    return run


#: Rows that join the texts by broadcast: a few MB of keys.
FEW_ROWS = 50_000


def _with_sets(docs: DataFrame, chosen: DataFrame, keep: list[str], words: int) -> DataFrame:
    """``keep`` columns (all longs) and the set ``s`` of each row of ``chosen``,
    which names texts by ``doc_id`` and ``tag``. Texts are exchanged unless the
    counted rows of ``chosen`` are few."""
    few = chosen.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    chosen = chosen.select("doc_id", "tag", *keep).hint("broadcast" if few else "shuffle_hash")
    texts = docs.select(F.col("doc_id").alias("t_id"), F.xxhash64("text").alias("t_tag"), "text")
    return texts.join(chosen, F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_tag") == F.col("tag"))) \
        .select(*keep, "text").mapInArrow(_sets(words, keep), ", ".join(f"{c} long" for c in keep) + ", s binary")


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _confirm_stars(percent: int):
    """Confirmed edges of stars; a star's rows follow the row of its centre."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for part in text_slices(batches, "s", 4 * SLICE_BYTES):
            a, b = [], []
            for *at, centre_first, nid, s in zip(*(part.column(k).to_pylist()
                                                   for k in ("a", "chunk", "centre_first", "nid", "s"))):
                mine = np.frombuffer(s, np.uint64)
                if centre_first == 0:  # repeated rows have the same set
                    key, centre = at, mine
                elif at == key and 100 * min(len(mine), len(centre)) >= percent * max(len(mine), len(centre)):
                    shared = len(np.intersect1d(mine, centre, assume_unique=True))
                    if 100 * shared >= percent * (len(mine) + len(centre) - shared):
                        a.append(at[0])
                        b.append(nid)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def confirmed_stars(docs: DataFrame, chosen: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """The edges (a, b) that are links on full sets. A star of many nodes is
    dealt in chunks, each with a copy of its centre's set."""
    many = edges.groupBy("a").agg(F.ceil(F.count("*") / TILE_NODES).cast("long").alias("chunks"))
    members = edges.join(many, "a").select(
        F.col("b").alias("nid"), "a", F.pmod(F.xxhash64("b", F.lit(5)), F.col("chunks")).alias("chunk"),
        F.lit(1).cast("long").alias("centre_first"))
    centres = many.select(F.col("a").alias("nid"), "a",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
                          F.lit(0).cast("long").alias("centre_first"))
    keep = ["a", "chunk", "centre_first", "nid"]
    rows = cut_lineage(members.unionByName(centres).join(chosen.select("nid", "doc_id", "tag"), "nid"))
    return _with_sets(docs, rows, keep, words).repartition(_partitions(docs), "a", "chunk") \
        .sortWithinPartitions("a", "chunk", "centre_first").mapInArrow(_confirm_stars(percent), "a long, b long")


def _confirm_tiles(percent: int):
    """Forests over the parts in the pairs of tiles of a partition, which comes
    sorted by them."""
    def forest(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        sets = {nid: (part, s) for nid, part, s in rows}  # repeated rows have the same set
        part = np.array([p for p, _ in sets.values()], np.int64)
        sizes = np.array([len(s) // 8 for _, s in sets.values()])
        shingles = np.frombuffer(b"".join(s for _, s in sets.values()), np.uint64)
        edges = np.array(linked_parts(shingles, sizes, part, percent), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for part in text_slices(batches, "s", 4 * SLICE_BYTES):
            for *at, nid, comp, s in zip(*(part.column(k).to_pylist() for k in ("cluster", "i", "j", "nid", "comp", "s"))):
                if at != key:
                    if len(rows) > 1:
                        yield forest(rows)
                    key, rows = at, []
                rows.append((nid, comp, s))
        if len(rows) > 1:
            yield forest(rows)
    return run


def linked_across(docs: DataFrame, parts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): edges that connect the parts of one cluster which links connect,
    on full sets. ``parts``: nid, doc_id, tag, n, cluster and comp, the part.

    Parts of several tiles have tiles of their own, smaller ones share tiles; a
    node meets every tile of its cluster but those of its own large part."""
    size = parts.groupBy("cluster", "comp").agg(F.sum("n").alias("n"), F.count("*").alias("k"))

    def tiles(n: str, k: str):
        return F.greatest(F.ceil(F.sum(n) / TILE_SHINGLES), F.ceil(F.sum(k) / TILE_NODES)).cast("long")

    size = size.withColumn("own", F.greatest(F.ceil(F.col("n") / TILE_SHINGLES), F.ceil(F.col("k") / TILE_NODES)))
    large = size.where("own > 1").select("cluster", "comp", F.col("own").cast("long").alias("own"))
    shared = size.where("own <= 1").groupBy("cluster").agg(tiles("n", "k").alias("shared"))
    # one row for each part of more than a tile
    before = Window.partitionBy("cluster").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    total = large.groupBy("cluster").agg(F.sum("own").alias("owned"))
    clusters = size.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high")) \
        .where("low != high").select("cluster").join(shared, "cluster", "left").join(total, "cluster", "left") \
        .select("cluster", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("owned", F.lit(0)).alias("owned"))
    large = large.withColumn("ahead", F.coalesce(F.sum("own").over(before), F.lit(0)))
    lie = parts.join(clusters, "cluster").join(large, ["cluster", "comp"], "left") \
        .withColumn("first", F.col("shared") + F.col("ahead"))
    placed = lie.withColumn("mine", F.when(
        F.col("own").isNull(), F.pmod(F.xxhash64("nid", F.lit(3)), F.greatest("shared", F.lit(1))))
        .otherwise(F.col("first") + F.pmod(F.xxhash64("nid", F.lit(3)), F.greatest("own", F.lit(1)))))
    others = F.sequence(F.lit(0).cast("long"), F.col("shared") + F.col("owned") - 1)
    met = F.filter(others, lambda t: F.col("own").isNull() | (t < F.col("first")) | (t >= F.col("first") + F.col("own")))
    dealt = cut_lineage(placed.withColumn("other", F.explode(met)).select(
        "doc_id", "tag", "nid", "cluster", "comp",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))
    return _with_sets(docs, dealt, ["cluster", "i", "j", "nid", "comp"], words) \
        .repartition(_partitions(docs), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j") \
        .mapInArrow(_confirm_tiles(percent), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(nid, comp): the smallest node that can be reached, for nodes with edges
    (a, b). Labels spread along edges and jump to their label's label until
    nothing changes."""
    both = cut_lineage(edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy("a").agg(F.min("b").alias("m")) \
        .select(F.col("a").alias("nid"), F.least("a", "m").alias("comp"))
    while True:
        near = both.join(label.select(F.col("nid").alias("b"), "comp"), "b") \
            .groupBy(F.col("a").alias("nid")).agg(F.min("comp").alias("m"))
        step = label.join(near, "nid").select("nid", "comp", F.least("comp", "m").alias("best"))
        jump = label.select(F.col("nid").alias("best"), F.col("comp").alias("far"))
        after = cut_lineage(step.join(jump, "best").select(
            "nid", "far", (F.col("far") != F.col("comp")).alias("moved")))
        label = after.select("nid", F.col("far").alias("comp"))
        if after.where("moved").isEmpty():
            return label


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(a, b) that chain nodes as all buckets do: each node and the smallest of
    its buckets' first nodes, and that one and the others of them."""
    rows = nodes.select("nid", F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("nid").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = rows.join(several.select("bucket", "first"), "bucket") \
        .groupBy("nid").agg(F.collect_set("first").alias("firsts"))  # at most one for each band
    return firsts.select(F.array_min("firsts").alias("a"),
                         F.explode(F.array_union("firsts", F.array("nid"))).alias("b")).where("a != b").distinct()


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS,
         rows: int = ROWS) -> DataFrame:
    """(doc_id, tag, n_shingles, component_id, is_head) of each document: the
    smallest id among all documents reachable over links, and whether id and tag
    are those of the one row chosen for them (repeated rows are all marked).
    Texts with no word (null too) have the empty set and link with nothing.
    Equal sets are linked; rows that share an id but not a text are nodes of
    their own; null ids rank last. An empty table gives an empty one."""
    info = cut_lineage(describe(docs, words, bands, rows))
    nodes = info.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("of"),
        F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    nodes = cut_lineage(nodes.withColumn("nid", F.monotonically_increasing_id()))
    edges = cut_lineage(candidate_edges(nodes))
    cluster = components(edges).withColumnRenamed("comp", "cluster")
    chosen = cut_lineage(nodes.select("nid", "of.doc_id", "of.tag", "n").join(cluster, "nid"))
    star = components(confirmed_stars(docs, chosen, edges, words, percent))
    parts = cut_lineage(chosen.join(star, "nid", "left").withColumn("comp", F.coalesce("comp", "nid")))
    across = components(linked_across(docs, parts, words, percent)) \
        .select(F.col("nid").alias("comp"), F.col("comp").alias("whole"))
    label = parts.join(across, "comp", "left").select("nid", F.coalesce("whole", "comp").alias("comp"))
    oldest = nodes.select("node", "nid", "of").join(label, "nid", "left") \
        .withColumn("comp", F.coalesce("comp", "nid"))
    head = oldest.groupBy("comp").agg(F.min("of").alias("head"))
    found = oldest.join(head, "comp").select("node", "head")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tag") == F.col("head.tag"))
    return info.drop("bands").join(found, "node", "left").select(
        "doc_id", "tag", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (F.col("node").isNull() | is_head).alias("is_head"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each group: the one with the smallest id (null ids last, ties
    by a hash of the text, rows that repeat both by a hash of all columns).
    Documents without a word are groups of their own. Columns stay as they are;
    an empty table gives an empty one."""
    kept = cut_lineage(link(docs, words, percent).where("is_head").groupBy(
        F.col("doc_id").alias("k_id"), F.col("tag").alias("k_tag")).agg(
        ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("repeats")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("tag"))
    rows = rows.join(kept.hint("shuffle_hash"),
                     F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("tag") == F.col("k_tag")))
    out = rows.where("NOT repeats").select("row")
    if not kept.where("repeats").isEmpty():
        again = rows.where("repeats").withColumn("h", F.xxhash64("row.*"))
        out = out.unionByName(again.groupBy("doc_id", "tag").agg(F.min_by("row", "h").alias("row")).select("row"))
    return out.select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """Per document: size of its set, the smallest id of its group, and whether
    that is its own; nulls, repeated rows and empty tables as in ``link``."""
    return link(docs.select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [l]
           ELSE list_transform(range(1, len(l) - 2), lambda i: l[i:i + 3]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS m FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) c ON n.doc_id = c.doc_id
"""
