"""Sharding by sampled splitters, with DataFrame functions only.

A size-weighted sample of text hashes gives splitters that cut the corpus into
many small ranges of about equal bytes; ranges that turn out overfull (one
group of equal texts holds too much) are subdivided by row. Exact sums
of the ranges, laid end to end, place every record on one line of bytes, which
is cut into shards of equal length. Equal texts lie next to each other and move
together unless their group is overfull.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from routewise.session import cut_lineage

SHARDS = 24
#: Ranges for each shard at least, rows of one range at most on average, and
#: sampled keys for each range.
RANGES = 64
ROWS = 1 << 20
KEYS = 32
#: Bits of the hash that index the splitters (a lookup of 2^12 rows).
CELL_BITS = 12


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of a sample in which a record's chance is in proportion to its
    size; at most about 2 * KEYS * ranges records are in it."""
    chance = F.col("size") * F.lit(float(KEYS * ranges) / total)
    drawn = F.pmod(F.xxhash64("nth", "h", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = [k / ranges for k in range(1, ranges)]
    found = rows.where(drawn < chance).agg(
        F.percentile_approx("h", at, F.lit(20 * ranges)).alias("s")).head().s
    return sorted(set(found or []))


def _lookup(rows: DataFrame, splitters: list[int]) -> DataFrame:
    """``rows`` with ``range``: the number of splitters below the hash."""
    shift = 64 - CELL_BITS
    cells: dict[int, list[int]] = {}
    for s in splitters:
        cells.setdefault(s >> shift, []).append(s)
    table, below = [], 0
    for cell in range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1):
        table.append((cell, below, cells.get(cell, [])))
        below += len(cells.get(cell, []))
    lookup = rows.sparkSession.createDataFrame(table, "cell long, below int, inside array<long>")
    return rows.withColumn("cell", F.shiftright("h", shift)).join(F.broadcast(lookup), "cell") \
        .withColumn("range", F.col("below") + F.expr("size(filter(inside, s -> s < h))")) \
        .drop("cell", "below", "inside")


def assign_shards(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per document. ``size`` is
    the text's UTF-8 bytes (null: none) plus 8; shards hold nearly equal bytes;
    slots count from 0 in each shard without gaps, in order of text hash and id.
    Null and repeated ids and repeated rows are records like others, ids may be of
    any type, and an empty table gives an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("nth")))
    total, count = rows.agg(F.sum("size"), F.count("*")).head()
    total, n = total or 1, max(shards * ranges, count // ROWS)
    rows = _lookup(rows, _splitters(rows, total, n))

    fair = total / n
    parts = F.when(F.col("bytes") > 2 * fair, F.ceil(F.col("bytes") / fair)).otherwise(1)
    overfull = rows.groupBy("range").agg(F.sum("size").alias("bytes")) \
        .select("range", parts.alias("parts"))  # at most n rows
    rows = rows.join(F.broadcast(overfull), "range").withColumn(
        "part", F.pmod(F.xxhash64("nth", F.lit(13)), F.col("parts")))

    # every range and part: at most 2 * n rows
    ahead = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")) \
        .select("range", "part",
                F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
                F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_ahead"))
    inside = Window.partitionBy("range", "part").orderBy("h", "doc_id", "nth")
    group = Window.partitionBy("range", "part", "h")
    placed = rows.join(F.broadcast(offsets), ["range", "part"]) \
        .withColumn("start", F.col("bytes_ahead") + F.sum("size").over(
            inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")) \
        .withColumn("nth_row", F.col("rows_ahead") + F.row_number().over(inside) - 1) \
        .withColumn("middle", F.min("start").over(group) + F.sum("size").over(group) / 2) \
        .withColumn("shard", F.least(F.lit(shards - 1),
                                     F.floor(F.col("middle") * shards / total)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("nth_row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth_row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as one folder for each shard, records in slot order. Ids
    must be unique and not null here, since they join texts to shards."""
    placed = assign_shards(docs, shards).select("doc_id", "shard", "slot")
    docs.drop("shard", "slot").join(placed, "doc_id").repartitionById(shards, "shard") \
        .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """``assign_shards`` under the law ``bytes``, with its rules for odd rows."""
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
