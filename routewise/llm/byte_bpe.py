"""Byte-level BPE through sentencepiece.

A sentencepiece BPE model is serialised directly from a rank file: piece i is
the byte string of rank i with every byte mapped to one printable character,
its score is -i, so sentencepiece merges the pair of lowest rank first, as the
rank file asks; normalisation is the identity. Texts are split into
pre-tokens, each encoded on its own; ids are decoded by the inverse byte map.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import list_array, text_slices, with_arrays, with_fields

SLICE_BYTES = 2 << 20
#: Pre-tokens whose ids a worker remembers; the memory is emptied when full.
CACHE_ENTRIES = 100_000


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable
    Latin-1 and no white space, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    chars, free = [], 0x100
    for b in range(256):
        if b in plain:
            chars.append(chr(b))
        else:
            chars.append(chr(free))
            free += 1
    return chars


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces: list[bytes] = [b""] * len(pairs)
    for code, rank in pairs:
        pieces[int(rank)] = base64.b64decode(code)
    if not all(pieces):
        raise ValueError("ranks must be 0 .. n-1, each once")
    if missing := [b for b in range(256) if bytes([b]) not in set(pieces)]:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    return pieces


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes are length-delimited, ints are
    varints, floats are 32 bits wide."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto with the pieces in rank order and one
    unknown piece after them. Field numbers are fixed by the public format."""
    chars = byte_characters()
    out = []
    for rank, piece in enumerate(pieces):
        text = "".join(chars[b] for b in piece).encode()
        out.append(_field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = (_field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
               + _field(41, none) + _field(42, none) + _field(43, none))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encodes lists of texts; remembers the ids of recent pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.model.unk_id()
        self.split = regex.compile(pattern).findall
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        """Ids of pre-tokens not met before. One that is itself a piece is
        that piece, whether or not merges would reach it."""
        mapped = [t.encode().decode("latin-1").translate(self.map) for t in new]
        whole = self.model.piece_to_id(mapped)
        merged = iter(self.model.encode(
            [m for m, i in zip(mapped, whole) if i == self.unknown], num_threads=1))
        ids = [next(merged) if i == self.unknown else [i] for i in whole]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.pool) + np.cumsum(lengths) - lengths
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32)])
        for j, t in enumerate(new, len(self.index)):
            self.index[t] = j
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        tokens = [self.split(t) for t in texts]
        new = set(chain.from_iterable(tokens)).difference(self.index)
        if len(self.index) + len(new) > CACHE_ENTRIES:
            self._forget()
            new = set(chain.from_iterable(tokens))
        if new:
            self._learn(list(new))
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(tokens)),
                            np.int64, int(counts.sum()))
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[which] - ends + lengths, lengths) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.pool[at], np.diff(bounds)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` array<int>: the ids of each whole text under
    the rank file at ``path``, pre-tokens split by ``pattern``, no special
    tokens. Null and empty texts give an empty array. A column of that name
    already there is replaced."""
    model = serialise_model(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        for part in text_slices(batches, text, SLICE_BYTES):
            ids, counts = encoder.encode([t or "" for t in part.column(text).to_pylist()])
            yield with_arrays(part, token_ids=list_array(pa.array(ids, pa.int32()), counts))

    schema = with_fields(df.schema, ("token_ids", T.ArrayType(T.IntegerType(), False)))
    return df.mapInArrow(run, schema)


class Decoder:
    """Bytes of ids: every piece through the inverse byte map."""

    def __init__(self, model):
        back = {ord(c): b for b, c in enumerate(byte_characters())}
        self.size = model.get_piece_size() - 1
        pieces = [p.translate(back).encode("latin-1") for p in model.id_to_piece(list(range(self.size)))]
        self.lengths = np.fromiter(map(len, pieces), np.int64, self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text, given all ids and the number of ids of each text."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError("token id outside the vocabulary")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - ends + n, n) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        data = self.flat[at].tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded`` binary: the bytes of each array of ids, by
    piece and inverse byte map. A null array decodes to no bytes; an id that is
    null or outside the vocabulary is an error."""
    model = serialise_model(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        decoder = Decoder(sentencepiece.SentencePieceProcessor(model_proto=model))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column(ids)
                counts = np.array([0 if v is None else v for v in
                                   pc.list_value_length(col).to_pylist()], np.int64)
                values = col.flatten()
                if values.null_count:
                    raise ValueError("null token id")
                out = decoder.decode(values.to_numpy().astype(np.int64), counts)
                yield with_arrays(part, decoded=pa.array(out, pa.binary()))

    return df.mapInArrow(run, with_fields(df.schema, ("decoded", T.BinaryType())))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` and, from them, ``decoded``: both steps in one
    worker, which loads the vocabulary once. Rules as in ``encode_texts``."""
    model = serialise_model(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        decoder = Decoder(encoder.model)
        for part in text_slices(batches, text, SLICE_BYTES):
            ids, counts = encoder.encode([t or "" for t in part.column(text).to_pylist()])
            yield with_arrays(part, token_ids=list_array(pa.array(ids, pa.int32()), counts),
                              decoded=pa.array(decoder.decode(ids, counts), pa.binary()))

    return df.mapInArrow(run, with_fields(df.schema, ("token_ids", T.ArrayType(T.IntegerType(), False)),
                                          ("decoded", T.BinaryType())))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded bytes."""
    done = round_trip(docs.select("doc_id", "text"), path, pattern)
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
