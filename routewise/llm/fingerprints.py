"""Document fingerprints: quartile bucket digests.

All byte triplets of a text, framed by bytes that no text holds, are hashed into
buckets and counted. The quartiles of the counts cut the buckets into four
classes, two bits each; in front stand the length on a logarithmic scale and the
ratios of the quartiles. Two digests differ by the steps between the classes of
their buckets and by the steps between their heads; the score is bounded, so
that unrelated texts and very unlike ones are equally far apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from routewise.session import save_table

from .common import flat_bytes, text_slices, with_arrays, with_fields

BUCKETS = 256
#: Bytes before the bucket codes: length and two quartile ratios.
HEAD = 3
#: Steps of the length code for each doubling of the length.
LENGTH_STEPS = 8
#: Two digests that differ by so much or more are as unlike as can be: classes
#: of unrelated buckets differ by 1.25 on average.
BOUND = 1.25 * BUCKETS
#: Length and ratio steps count so much, and at most as much as this many buckets.
LENGTH_WEIGHT, RATIO_WEIGHT, HEAD_MOST = 1.0, 0.5, 32
SLICE_BYTES = 1 << 20

_FRAME = 0xFF  # never a byte of UTF-8


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) numbers of hashed triplets of each text, which is framed
    by two marks on both sides, so that even an empty text has two triplets."""
    n = len(offsets) - 1
    framed = np.full(len(data) + 4 * n, _FRAME, np.uint32)
    of = np.repeat(np.arange(n), np.diff(offsets))
    framed[np.arange(len(data)) + 4 * of + 2] = data
    key = framed[:-2] | framed[1:-1] << np.uint32(8) | framed[2:] << np.uint32(16)
    key *= np.uint32(0x9E3779B1)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA77)
    size = np.diff(offsets) + 2
    text = np.repeat(np.arange(n), size)
    place = np.arange(int(size.sum())) + 2 * text  # triplets over two texts are left out
    bucket = (key[place] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return np.bincount(text * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)


def digests(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(texts, HEAD + BUCKETS / 4) bytes."""
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, [BUCKETS * k // 4 - 1]] for k in (1, 2, 3))
    classes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    out = np.empty((len(counts), HEAD + BUCKETS // 4), np.uint8)
    out[:, 0] = np.minimum(255, np.round(LENGTH_STEPS * np.log2(lengths + 1)))
    top = np.maximum(q3[:, 0], 1)
    out[:, 1] = 16 * q1[:, 0] // top
    out[:, 2] = 16 * q2[:, 0] // top
    four = classes.reshape(len(counts), -1, 4)
    out[:, HEAD:] = four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6
    return out


def _steps() -> np.ndarray:
    """(256, 256) steps between the four classes packed into two bytes."""
    code = np.arange(256)
    classes = np.stack([code >> s & 3 for s in (0, 2, 4, 6)], axis=1).astype(np.int16)
    return np.abs(classes[:, None, :] - classes[None, :, :]).sum(axis=2).astype(np.uint8)


STEPS = _steps()


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference of two arrays of digests, row by row."""
    apart = STEPS[a[:, HEAD:], b[:, HEAD:]].sum(axis=1, dtype=np.int64).astype(np.float64)
    head = np.abs(a[:, :HEAD].astype(np.int64) - b[:, :HEAD])
    apart += np.minimum(HEAD_MOST, LENGTH_WEIGHT * head[:, 0] + RATIO_WEIGHT * (head[:, 1] + head[:, 2]))
    return np.minimum(apart, BOUND)


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 at the bound."""
    return 1 - differences(a, b) / BOUND


def _of_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return digests(bucket_counts(data, offsets), np.diff(offsets))


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def add_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the digest of each ``text`` as hex text.

    A null text counts as empty. Equal texts have equal digests; repeated rows
    and other columns change nothing; a column named like the result is
    replaced; an empty table gives an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text, SLICE_BYTES):
            yield with_arrays(part, fingerprint=pa.array(_hex(_of_texts(*flat_bytes(part.column(text)))), pa.string()))

    return docs.mapInArrow(run, with_fields(docs.schema, ("fingerprint", docs.schema[text].dataType)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two digests, 0 to 1; null if one is null."""
    @F.pandas_udf("double")
    def compared(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(None, index=x.index, dtype=object)
        both = x.notna() & y.notna()
        if both.any():
            rows = [np.frombuffer(bytes.fromhex("".join(c[both])), np.uint8).reshape(int(both.sum()), -1)
                    for c in (x, y)]
            out[both] = likeness_of(*rows)
        return out

    return compared(a, b)


# --- each document beside its edited text and its neighbour -----------------

FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edited(text: str, following: str) -> str:
    """``text`` whose last third is replaced by the start of ``following``."""
    swapped = len(text) // 3
    return text[:len(text) - swapped] + following[:swapped]


def _compared(ids: list, texts: list[str], following: str, id_type: pa.DataType) -> pa.RecordBatch:
    """Result rows of neighbours, the last of which is followed by ``following``."""
    def flat(values: list[str]) -> np.ndarray:
        return _of_texts(*flat_bytes(pa.array(values, pa.large_string())))

    own = flat([*texts, following])
    edited = [_edited(t, f) for t, f in zip(texts, [*texts[1:], following])]
    other = flat(edited)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(_hex(own[:-1])), pa.array(_hex(other)),
        pa.array(likeness_of(own[:-1], other)), pa.array(likeness_of(own[:-1], own[1:]))], FIELDS)


def report(docs: DataFrame) -> DataFrame:
    """Per document: its digest, the digest of its text after an edit (the last
    third replaced by the start of the next document), and the likeness of its
    digest to the edited text's and to the next document's.

    Documents follow each other by descending id, null ids last, rows of one id
    by a hash of their text; after the last comes the first. A document alone is
    its own neighbour. Null texts count as empty; an empty table gives an empty
    one. Texts are range-partitioned once; a task compares neighbours as they
    stream past and puts its first and last text aside, and what is aside is
    joined afterwards, one row for each task."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key[:2])
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = [("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
               ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row so far: it waits for its neighbour
        id_type, part, begun = None, TaskContext.get().partitionId(), False

        def aside(row: tuple, first: bool) -> pa.RecordBatch:
            blank = {"doc_id": pa.array([row[0]], id_type),
                     **{n: pa.nulls(1, pa.float64() if k == "double" else pa.int64() if k == "long" else pa.string())
                        for n, k in numbers}}
            return pa.RecordBatch.from_arrays(
                [*blank.values(), pa.array([part], pa.int32()), pa.array([first]), pa.array([row[1]], pa.string())],
                [*blank, "part", "is_first", "text"])

        for batch in text_slices(batches, "text", SLICE_BYTES):
            id_type = batch.schema.field("doc_id").type
            new = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
            if not begun:
                begun = True
                yield aside(new[0], True)
            held += new
            done, held = held[:-1], held[-1:]
            if done:
                out = _compared([d for d, _ in done], [t for _, t in done], held[0][1], id_type)
                n = out.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())],
                    [*FIELDS, "part", "is_first", "text"])
        if held:
            yield aside(held[0], False)

    fields = ", ".join(f"{n} {k}" for n, k in numbers)
    streamed = save_table(rows.mapInArrow(
        run, f"doc_id {id_kind}, {fields}, part int, is_first boolean, text string"))
    firsts = streamed.where("is_first").select("part", F.col("text").alias("following"))
    lasts = streamed.where("NOT is_first").select("doc_id", "part", "text")
    # one number for each task that had rows
    around = Window.orderBy("part")
    order = firsts.select("part").withColumn("after", F.coalesce(
        F.lead("part").over(around), F.first("part").over(around)))
    ends = lasts.join(order, "part").drop("part").join(
        firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for d, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
                yield _compared([d], [t], f, id_type)

    return streamed.where("part IS NULL").select(*FIELDS).unionByName(
        ends.mapInArrow(finish, f"doc_id {id_kind}, {fields}"))
