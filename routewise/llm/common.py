"""Helpers shared by the training-data operators: bounded Arrow slices, text
as flat bytes, hashes of byte spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with the named fields added; a field of the same name (in
    any case, as Spark compares names) is replaced."""
    names = {n.lower() for n, _ in fields}
    kept = [f for f in schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(n, t) for n, t in fields])


def with_arrays(batch: pa.RecordBatch, **arrays: pa.Array) -> pa.RecordBatch:
    """``batch`` with columns added at the end, in the order of ``with_fields``."""
    lower = {n.lower() for n in arrays}
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in lower]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in keep] + list(arrays.values()),
        [batch.schema.names[i] for i in keep] + list(arrays))


def sealed(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: none clashes with a column that
    is added, and nothing travels twice. ``opened`` undoes it."""
    return df.select([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])


def opened(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def sealed_name(df: DataFrame, column: str) -> str:
    """The name of a column of ``df`` after ``sealed``."""
    return f"c{[c.lower() for c in df.columns].index(column.lower())}"


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches holding at most ``max_bytes`` of ``column``
    each (a longer single value makes a slice of its own), so that working
    memory does not depend on the batch size the session was given."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 bytes of all values one after another, int64 offsets of the
    len + 1 boundaries); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def byte_values(column: pa.Array) -> list[bytes]:
    """The values as Python bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def list_array(flat: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold of a document.
    A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


# --- hashes of byte spans -------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, stop) of ``data``; equal bytes
    give equal hashes wherever they stand. One pass over the data: prefix sums
    of byte codes times powers of an odd base, shifted back by its inverse."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(BYTE_CODE[data] * _powers(_BASE, len(data)), out=prefix[1:])
    back = _powers(_BASE_INV, len(data) + 1)
    length = (stops - starts).astype(np.uint64)
    return mix64((prefix[stops] - prefix[starts]) * back[starts] + length)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Words (runs of bytes other than ASCII white space, A-Z lowered) of texts
    given as flat bytes: (lowered bytes, word starts, word stops, number of
    words of each text). Words never span two texts."""
    low = _LOWER[data]
    inside = ~_SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(low)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return low, starts, stops, counts
