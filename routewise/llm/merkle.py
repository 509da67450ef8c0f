"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf. The leaves of one group form a tree of runs of 16, the
roots of the groups another one. Leaves are appended in order by a stream over
aligned blocks: a leaf joins the open subtree of its level, and when a subtree
is complete each node in it extends the witnesses of all leaves below with its
siblings. A block is an aligned subtree of three levels, so blocks grow in
different tasks; their roots are nodes of the same tree and are appended again
as leaves of the next round, until each group has one node.

Nodes and witnesses of upper rounds are handed down one block at a time: a block
row (its siblings on the path to the root) heads the stream of the nodes of its
block, so nothing is broadcast and a task holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from routewise.session import save_table

from .common import remainder

FANOUT = 16
#: Levels that a block grows by: 4,096 nodes.
LEVELS = 3
#: Leaves whose witnesses travel in one Arrow batch.
SLICE = 512


def node_hash(children: str) -> str:
    """Lowercase hex SHA-256 of hex digests laid end to end."""
    return hashlib.sha256(children.encode()).hexdigest()


class Frontier:
    """The open subtrees of a block that grows by appending nodes.

    ``witness[i]`` is the partial witness of the i-th node: for each level
    completed so far its place in the run and the run's other nodes."""

    def __init__(self, levels: int):
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]
        self.witness: list[list[tuple[int, str]]] = []

    def append(self, node: str) -> None:
        i = len(self.witness)
        self.witness.append([])
        self.open[0].append((node, i, i + 1))
        level = 0
        while level + 1 < len(self.open) and len(self.open[level]) == FANOUT:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _, _ in run]
        for place, (_, first, stop) in enumerate(run):
            step = (place, "".join(nodes[:place] + nodes[place + 1:]))
            for i in range(first, stop):
                self.witness[i].append(step)
        self.open[level + 1].append((node_hash("".join(nodes)), run[0][1], run[-1][2]))

    def close(self) -> str:
        """The root, after the last, partly filled runs are completed."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._complete(level)
        (root, _, _), = self.open[-1]
        return root


def fold(node: str, witness: list[tuple[int, str]]) -> str:
    """The root that a node has under its witness."""
    for place, others in witness:
        cut = place * len(node)
        node = node_hash(others[:cut] + node + others[cut:])
    return node


def _height(nodes: int, most: int) -> int:
    """Levels that a block of a tree with so many nodes grows by."""
    levels, size = 0, 1
    while size < nodes and levels < most:
        levels, size = levels + 1, size * FANOUT
    return levels


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Digest of a row: every value as its UTF-8 byte count, a colon and itself;
    a null is a dash."""
    return F.sha2(F.concat(*[_field(v) for v in values]).cast("binary"), 256)


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``rows``, which have a unique column ``nth``, with their ``position`` in
    their tree (by ``order``) and the tree's number of rows ``n``. Rows are
    range-partitioned by tree and order, so a tree may span all partitions."""
    key = [F.col(tree).asc_nulls_first(), *order, F.col("nth")]
    at = F.monotonically_increasing_id()
    sorted_ = save_table(rows.repartitionByRange(*key).sortWithinPartitions(*key)
                         .withColumn("part", F.shiftright(at, 33))
                         .withColumn("at", at.bitwiseAND((1 << 33) - 1)))
    counts = sorted_.groupBy(F.col(tree).alias("_tree"), F.col("part").alias("_part")).agg(
        F.min("at").alias("_first"), F.count("*").alias("_rows"))
    # one row for each tree and each partition it lies in
    by_tree = Window.partitionBy("_tree")
    before = by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))) \
        .withColumn("n", F.sum("_rows").over(by_tree))
    return sorted_.join(counts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part"))) \
        .withColumn("position", F.col("at") - F.col("_first") + F.col("_before")) \
        .drop("_tree", "_part", "_first", "_rows", "_before", "part", "at")


def _block(position: Column, levels: int) -> Column:
    return F.floor(position / FANOUT ** levels).cast("long")


def _grown(levels: int):
    """One row for each block of nodes, which come sorted by tree and position."""
    size = FANOUT ** levels

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
            ["tree", "position", "n", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, grown, out = None, None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("tree", "position", "n", "node"))
            for tree, position, n, node in zip(*columns):
                if (tree, position // size) != key:
                    if grown:
                        out.append((*key, left, grown.close()))
                    key, left = (tree, position // size), -(-n // size)
                    grown = Frontier(_height(n, levels))
                grown.append(node)
            if len(out) >= SLICE:
                yield rows(out)
                out = []
        if grown:
            out.append((*key, left, grown.close()))
        if out:
            yield rows(out)
    return run


NODE = "tree long, position long, n long, node string"


def grow(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of (tree, position, n, node): the nodes given, the roots of their
    blocks, and so on, until every tree has one node. Tables in the shared folder."""
    rounds = [nodes]
    while not rounds[-1].where("n > 1").isEmpty():
        last = rounds[-1].select("tree", "position", "n", "node")
        rounds.append(save_table(
            last.repartition("tree", _block(F.col("position"), levels))
            .sortWithinPartitions("tree", "position").mapInArrow(_grown(levels), NODE)))
    return rounds


_STEPS = "places array<int>, others array<string>"


def _witnessed(payload: list[str], levels: int):
    """Streams of blocks, each headed by the row of its root: every node with
    the steps to its block's root and then the head's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, head = [], None

        def block() -> Iterator[pa.RecordBatch]:
            grown = Frontier(_height(rows[0]["n"], levels))
            for r in rows:
                grown.append(r["node"])
            grown.close()
            for k in range(0, len(rows), SLICE):
                part = rows[k:k + SLICE]
                steps = grown.witness[k:k + SLICE]
                columns = {c: [r[c] for r in part] for c in payload}
                columns["places"] = [[p for p, _ in s] + head["places"] for s in steps]
                columns["others"] = [[o for _, o in s] + head["others"] for s in steps]
                columns["subroot"] = [head["subroot"]] * len(part)
                columns["root"] = [head["root"]] * len(part)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, schema.field(c).type) for c, v in columns.items()})

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field(c) for c in
                                    [*payload, "places", "others", "subroot", "root"]])
            for r in batch.to_pylist():
                if r["is_head"]:
                    if rows:
                        yield from block()
                    rows, head = [], r
                else:
                    rows.append(r)
        if rows:
            yield from block()
    return run


def hand_down(nodes: DataFrame, heads: DataFrame, payload: list[str], levels: int = LEVELS) -> DataFrame:
    """``payload`` of every node with its whole witness (``places`` in the runs
    on its path and ``others``, the siblings there), ``subroot`` and ``root``.
    ``heads``: the same of every block of the nodes, as (tree, position, ...)."""
    kinds = {f.name: f.dataType for f in nodes.schema}
    names = list(dict.fromkeys([*payload, "tree", "position", "n", "node"]))
    stream = nodes.select(
        *names, F.lit(False).alias("is_head"), _block(F.col("position"), levels).alias("block"),
        F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<string>").alias("others"),
        F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    first = heads.select(
        *[F.col("tree") if c == "tree" else (F.col("position") * FANOUT ** levels).alias(c) if c == "position"
          else F.lit(None).cast(kinds[c]).alias(c) for c in names],
        F.lit(True).alias("is_head"), F.col("position").alias("block"), "places", "others", "subroot", "root")
    fields = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in payload)
    return stream.unionByName(first).repartition("tree", "block") \
        .sortWithinPartitions("tree", "block", F.desc("is_head"), "position") \
        .mapInArrow(_witnessed(payload, levels), f"{fields}, {_STEPS}, subroot string, root string")


def _down(rounds: list[DataFrame], tops: DataFrame, payload: list[str], levels: int) -> DataFrame:
    """Witnesses of the first round's nodes, from the ones of the trees' roots."""
    for nodes in reversed(rounds[1:-1]):
        tops = save_table(hand_down(nodes, tops, ["tree", "position"], levels))
    return hand_down(rounds[0], tops, payload, levels)


def manifest(leaves: DataFrame, group: str = "source", order: tuple[str, ...] = ("doc_id",),
             payload: tuple[str, ...] = (), levels: int = LEVELS) -> DataFrame:
    """(payload, leaf, places, others, subroot, root) of every row of
    ``leaves``, which has the columns ``group``, ``order``, ``leaf`` and
    ``payload``. A row's witness is one step for each level up to the root: its
    place in the run and the run's other nodes, left to right.

    Inside a group leaves ascend by ``order`` (nulls first, ties by digest), and
    groups by their value (null first, bytes of its text); rows that repeat are
    leaves of their own. An empty table gives an empty one. Columns of other
    names are not looked at."""
    names = [f"p{k}" for k in range(len(payload))]  # clear of this module's own columns
    rows = leaves.select(F.col(group).cast("string").alias("group"), F.col("leaf").alias("node"),
                         *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)],
                         *[F.col(c).alias(n) for n, c in zip(names, payload)])
    # nth tells equal rows apart; it is stored, so it stays as it is
    rows = save_table(rows.withColumn("nth", F.monotonically_increasing_id()))
    order_by = [*[F.col(f"o{k}").asc_nulls_first() for k in range(len(order))], F.col("node")]
    placed = numbered(rows, "group", order_by)
    groups = placed.where("position = 0").select("group", "n", F.col("nth").alias("tree"))
    groups = save_table(groups)  # a tree is named by its first leaf
    placed = save_table(placed.select("group", "node", *names, "position", "n").join(
        groups.select(F.col("group").alias("_g"), "tree"), F.col("group").eqNullSafe(F.col("_g"))).drop("_g", "group"))

    rounds = grow(placed, levels)
    subroots = rounds[-1].select("tree", F.col("node").alias("node"))
    forest = groups.select("group", "tree").join(subroots, "tree") \
        .select(F.lit(0).alias("one"), "group", "node", F.col("tree").alias("nth"))
    forest = numbered(forest, "one", [F.col("group").asc_nulls_first()]) \
        .select(F.lit(0).cast("long").alias("tree"), "position", "n", "node", F.col("nth").alias("p0"))
    above = grow(save_table(forest), levels)
    nothing = above[-1].select("tree", "position", F.array().cast("array<int>").alias("places"),
                               F.array().cast("array<string>").alias("others"),
                               F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    roots = _down(above, nothing, ["p0", "node"], levels)
    tops = save_table(roots.select(F.col("p0").alias("tree"), F.lit(0).cast("long").alias("position"),
                                   "places", "others", F.col("node").alias("subroot"), "root"))
    return _down(rounds, tops, [*names, "node"], levels).select(
        *[F.col(n).alias(c) for n, c in zip(names, payload)], F.col("node").alias("leaf"),
        "places", "others", "subroot", "root")


def folded(leaf: Column, places: Column, others: Column) -> Column:
    """The root that a leaf has under a witness."""
    steps = F.zip_with(places, others, lambda p, o: F.struct(p.alias("p"), o.alias("o")))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(
        F.substr(s.o, F.lit(1), s.p * 64), node, F.substr(s.o, s.p * 64 + 1)).cast("binary"), 256))


def report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per document: leaf, subroot of its source, root, digest of its witness,
    and the root folded from the document as found: one in five texts is
    tampered with (A-Z lowered; a null id counts as the empty text there)."""
    def leaf(text: Column) -> Column:
        return leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(remainder(F.col("doc_id"), 5) == 0, leaf(lowered))  # null: as it was
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), shown.alias("shown"))
    done = manifest(leaves, payload=("doc_id", "shown"), levels=levels)
    return done.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join("others", "").cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("shown", "leaf"), F.col("places"), F.col("others")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS s,
         head_text AS head, text FROM (SELECT *, concat(
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'),
           coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
           coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head_text
         FROM documents)),
z AS (
  SELECT doc_id, source, head, text,
         xor(list_reduce(flatten(list_transform(range(1, len(s) + 1),
           lambda i: [CAST(ord(s[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
           lambda acc, b: xor(xor(acc, b) >> 1, 3988292384 * (xor(acc, b) & 1)), 4294967295), 4294967295) AS h FROM c),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN h % 5 = 0 THEN translate(text,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS shown FROM z),
p AS (
  SELECT doc_id, leaf, shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (
  SELECT grp, 0 AS level, pos, leaf AS node, n FROM p
  UNION ALL
  SELECT grp, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM t
  WHERE n > 1 GROUP BY grp, level, pos // 16, n),
g AS (SELECT grp, node, max(grp) OVER () + 1 AS n FROM t WHERE n = 1),
f AS (
  SELECT 0 AS level, grp AS pos, node, n FROM g
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM f
  WHERE n > 1 GROUP BY level, pos // 16, n),
tr AS (SELECT grp, level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM t WHERE n > 1
       GROUP BY grp, level, pos // 16),
fr AS (SELECT level, pos // 16 AS run, list(node ORDER BY pos) AS nodes FROM f WHERE n > 1 GROUP BY level, pos // 16),
w AS (
  SELECT grp, pos AS nth, 0 AS level, pos, shown AS node, '' AS proof FROM p
  UNION ALL
  SELECT w.grp, nth, w.level + 1, pos // 16,
         sha256(list_aggregate(nodes[:pos % 16] || [node] || nodes[pos % 16 + 2:], 'string_agg', '')),
         proof || coalesce(list_aggregate(nodes[:pos % 16] || nodes[pos % 16 + 2:], 'string_agg', ''), '')
  FROM w JOIN tr ON w.grp = tr.grp AND w.level = tr.level AND tr.run = pos // 16),
wt AS (SELECT grp, nth, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM w GROUP BY grp, nth),
v AS (
  SELECT grp, nth, 0 AS level, grp AS pos, node, proof FROM wt
  UNION ALL
  SELECT v.grp, nth, v.level + 1, pos // 16,
         sha256(list_aggregate(nodes[:pos % 16] || [node] || nodes[pos % 16 + 2:], 'string_agg', '')),
         proof || coalesce(list_aggregate(nodes[:pos % 16] || nodes[pos % 16 + 2:], 'string_agg', ''), '')
  FROM v JOIN fr ON v.level = fr.level AND fr.run = pos // 16),
vt AS (SELECT grp, nth, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM v GROUP BY grp, nth),
top AS (SELECT node AS root FROM f WHERE n = 1)
SELECT doc_id, leaf, g.node AS subroot, root, sha256(vt.proof) AS proof_sha256, vt.node AS folded_root,
       vt.node = root AS verified
FROM p JOIN vt ON p.grp = vt.grp AND p.pos = vt.nth JOIN g ON g.grp = p.grp CROSS JOIN top
"""
