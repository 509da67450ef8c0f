"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt into blocks, and every block keeps one sorted list of its
values for each component. For a query the lists are read from their better
end, a run of entries at a time. Entries read so far give each vector a lower
bound (unread components at their worst) and an upper bound (unread components
at the place reading has reached); vectors whose upper bound stays below the
k-th best lower bound are out and are not looked at any more. When few are
left, their missing components are added. Blocks hand on k rows a query, which
are ranked together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from routewise.session import cut_lineage

K = 10
SCALE = 1024
#: Vectors in a block of candidates, queries in a chunk.
BLOCK = 4096
CHUNK = 512


def quantised(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v array<long>): floor(1024 * x) of every usable vector. Null ids and
    vectors, empty vectors and vectors with null or non-finite components take
    no part. Rows that share an id stay rows of their own."""
    x = F.col(vector).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(usable).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


class Block:
    """Vectors of one block with a sorted list for each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(ids))[:, None], axis=0)

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query number, id, score) of the k best of each query, ties to the
        smaller id. All queries read to the same depth; lists are read from above
        for positive components of a query and from below for negative ones."""
        n, rows = len(self.ids), np.arange(len(self.ids))
        number = np.arange(len(query_ids))
        out: list[tuple[int, int, int]] = []
        depth = max(16, n // 8)
        while len(number):
            depth = min(depth, n)
            x, rank = self.x[rows], self.rank[rows]
            above, below = rank >= n - depth, rank < depth
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            known = (x * above) @ up.T + (x * below) @ down.T
            lower = upper = known
            if depth < n:  # unread components: at worst, and at the place reading has reached
                unread_up, unread_down = (~above).astype(x.dtype), (~below).astype(x.dtype)
                lower = known + unread_up @ (up * self.sorted[0]).T \
                    + unread_down @ (down * self.sorted[-1]).T
                upper = known + unread_up @ (up * self.sorted[n - depth]).T \
                    + unread_down @ (down * self.sorted[depth - 1]).T
            other = self.ids[rows][:, None] != query_ids
            least = np.array(np.iinfo(np.int64).min if x.dtype.kind == "i" else -np.inf, x.dtype)
            lower = np.where(other, lower, least)
            kth = np.partition(lower, len(rows) - k, axis=0)[len(rows) - k] if len(rows) > k else least
            alive = (upper >= kth) & other
            settled = (alive.sum(axis=0) <= 4 * k) | (depth == n)
            for j in np.flatnonzero(settled):
                left = np.flatnonzero(alive[:, j])
                score = x[left] @ q[j]
                ids = self.ids[rows[left]]
                best = np.lexsort((ids, -score))[:k]
                out += [(int(number[j]), int(ids[b]), int(score[b])) for b in best]
            number, query_ids, q = number[~settled], query_ids[~settled], q[~settled]
            rows = rows[alive[:, ~settled].any(axis=1)]  # outsiders of all queries are done
            depth *= 2
        return out


def _number_type(*arrays: np.ndarray):
    """Doubles where every partial score is an exact integer in them (fast
    products), else 64-bit integers."""
    most = [float(np.abs(a.astype(np.float64)).max(initial=0)) for a in arrays]
    return np.float64 if most[0] * most[1] * arrays[0].shape[1] < 2.0**52 else np.int64


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    return a.flatten().to_numpy().reshape(len(a), -1)


def _answer(k: int):
    def run(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if candidates.num_rows and queries.num_rows:
            x, q = _matrix(candidates["v"]), _matrix(queries["v"])
            kind = _number_type(x, q)
            block = Block(candidates["id"].to_numpy(), x.astype(kind))
            out = block.top(queries["id"].to_numpy(), q.astype(kind), k)
        a = np.array(out, np.int64).reshape(-1, 3)
        return pa.table({"query_row": queries["row"].to_numpy()[a[:, 0]] if len(a) else a[:, 0],
                         "query_id": queries["id"].to_numpy()[a[:, 0]] if len(a) else a[:, 0],
                         "vec_id": a[:, 1], "score": a[:, 2]})
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each
    query with all vectors but those of its own id, ties to the smaller id. Only
    vectors as long as the query take part with it. Rows that share an id are
    candidates and queries of their own; an empty table gives an empty one."""
    x = quantised(vectors, vec_id, vector).withColumn("dims", F.size("v"))
    q = cut_lineage(quantised(queries, vec_id, vector).withColumn("dims", F.size("v"))
                    .withColumn("row", F.monotonically_increasing_id()))
    blocks = -(-vectors.count() // BLOCK) or 1
    chunks = -(-queries.count() // CHUNK) or 1
    x = x.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks))) \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    q = q.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dims", "block", "chunk"]
    found = x.groupBy(keys).cogroup(q.groupBy(keys)).applyInArrow(
        _answer(k), "query_row long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """Queries: the vectors whose id is divisible by 100. Nulls, repeated rows
    and empty tables as in ``top_k``."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH usable AS (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.nth, q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""
