"""Hidden Markov language model over words.

A token is emitted in two steps: the hidden state emits a class of tokens (a
hash bucket; the end of text is a class of its own), and the class emits the
token with its smoothed share of the class in the training texts. Baum-Welch
trains the states on all training texts: tasks run the scaled forward-backward
recursion over whole texts and send expected counts, which are summed by class.
Long texts are stepped through in segments side by side; products of the steps
of each segment carry the states over its borders, so no text is cut. Scores
are exact likelihoods by the scaled forward recursion over the whole text.

Token counts cover the whole corpus and are never gathered on the driver: texts
are dealt into blocks, a block asks for the counts of its own words and gets
them back. What travels with tasks is the state table, of fixed size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from routewise.session import save_table

from .common import byte_values, flat_bytes, mix64, remainder, span_hashes, text_slices, words_of

STATES = 6
CLASSES = 8192
ITERATIONS = 3
#: Chance at the start of training that a state follows itself.
STICKY = 0.95
#: Expected counts added to every class of every state, times the class's share.
PRIOR = 50.0
#: Tokens that are stepped through one after the other; longer texts are several
#: segments, whose borders are known before. It does not change any count.
SEGMENT = 128
#: Steps between two rescalings of a product.
RESCALE = 8
SLICE_BYTES = 1 << 20
#: Bytes of classes (two a token) that are trained at once.
TRAIN_BYTES = 1 << 19
#: Bytes of text in one block of documents.
BLOCK_BYTES = 12 << 20
#: Fold of documents that are never learned from: remainder 2 of 7.
FOLDS, HELD_OUT = 7, 2
END = CLASSES  # class of the end of a text

#: Classes in one row of summed counts.
_CHUNK = 64


def held_out() -> Column:
    return remainder(F.col("doc_id"), FOLDS) == HELD_OUT


def classes_of(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) % np.uint64(CLASSES)).astype(np.int64)


def class_sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all tokens of all texts, each text closed by END; number of
    tokens of each text)."""
    data, offsets = flat_bytes(column)
    low, starts, stops, counts = words_of(data, offsets)
    out = np.full(int(counts.sum()) + len(counts), END, np.int64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(counts)), counts)] = \
        classes_of(span_hashes(low, starts, stops))
    return out, counts + 1


def word_classes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(length)
    return classes_of(span_hashes(data, stops - length, stops))


@dataclass
class Model:
    start: np.ndarray   # states
    follow: np.ndarray  # states x states
    emit: np.ndarray    # classes and END x states

    @classmethod
    def initial(cls, share: np.ndarray) -> Model:
        """Classes in proportion to their share, shaken at random in each state
        so that training can tell the states apart."""
        shaken = share[:, None] * np.exp(np.random.default_rng(7).normal(0, 1, (len(share), STATES)))
        follow = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1))
        np.fill_diagonal(follow, STICKY)
        return cls(np.full(STATES, 1 / STATES), follow, shaken / shaken.sum(axis=0))

    @classmethod
    def from_counts(cls, starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray,
                    share: np.ndarray) -> Model:
        emitted = emitted + PRIOR * share[:, None]
        moves = moves + 1.0
        starts = starts + 1.0
        return cls(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True),
                   emitted / emitted.sum(axis=0))


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of sequences by falling length, first token of each in that order,
    number of sequences that are longer than t for each t)."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    alive = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
    return order, starts, alive


def forward(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each class sequence by the scaled forward recursion."""
    order, starts, alive = _layout(lengths)
    log = np.zeros(len(lengths))
    a = np.tile(model.start, (len(lengths), 1))
    for t, n in enumerate(alive):
        a = a[:n] if t == 0 else a[:n] @ model.follow
        a *= model.emit[tokens[starts[:n] + t]]
        scale = a.sum(axis=1)
        a /= scale[:, None]
        log[:n] += np.log10(scale)
    out = np.empty(len(lengths))
    out[order] = log
    return out


def _products(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each sequence the scaled product of its steps: weights (state before
    the first emission, state of the last token)."""
    order, starts, alive = _layout(lengths)
    a = np.tile(np.eye(STATES), (len(lengths), 1, 1))
    for t, n in enumerate(alive):
        now = a[:n] if t == 0 else (a[:n].reshape(-1, STATES) @ model.follow).reshape(n, STATES, STATES)
        now = now * model.emit[tokens[starts[:n] + t]][:, None]
        if t % RESCALE == RESCALE - 1:
            now /= now.sum(axis=(1, 2), keepdims=True)
        a[:n] = now
    out = np.empty_like(a)
    out[order] = a / a.sum(axis=(1, 2), keepdims=True)
    return out


def _borders(model: Model, products: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chances of the states before the first emission of each segment, given the
    text before it; weights of the states of its last token, given the text after
    it). ``segments`` is the number of segments of each text."""
    _, starts, alive = _layout(segments)
    enter = np.tile(model.start, (len(products), 1))
    leave = np.ones((len(products), STATES))
    for k, n in enumerate(alive[1:], 1):
        here = starts[:n] + k
        a = (enter[here - 1][:, None] @ products[here - 1])[:, 0]
        enter[here] = a / a.sum(axis=1, keepdims=True) @ model.follow
    for k in range(len(alive) - 1, 0, -1):
        here = starts[:alive[k]] + k
        b = (products[here] @ leave[here][:, :, None])[:, :, 0] @ model.follow.T
        leave[here - 1] = b / b.sum(axis=1, keepdims=True)
    return enter, leave


def expected_counts(model: Model, tokens: np.ndarray, lengths: np.ndarray):
    """(starts, moves, emitted) of the posterior state paths of whole texts."""
    lengths, segments, head = _segments(lengths)
    enter = np.tile(model.start, (len(lengths), 1))
    leave = np.ones((len(lengths), STATES))
    many = np.repeat(segments > 1, segments)
    if many.any():
        products = _products(model, tokens[np.repeat(many, lengths)], lengths[many])
        enter[many], leave[many] = _borders(model, products, segments[segments > 1])

    order, starts, alive = _layout(lengths)
    at = [starts[:n] + t for t, n in enumerate(alive)]
    leave = leave[order]
    scales, a = [], enter[order]
    posterior = np.empty((len(tokens), STATES))
    for t, place in enumerate(at):
        a = a[:len(place)] if t == 0 else a[:len(place)] @ model.follow
        a = a * model.emit[tokens[place]]
        scale = a.sum(axis=1, keepdims=True)
        a /= scale
        posterior[place] = a
        scales.append(scale)
    last = posterior[np.cumsum(lengths) - 1]  # given the text up to the segment's end
    moves = np.zeros((STATES, STATES))
    later = np.ones((0, STATES))
    for t in range(len(at) - 1, -1, -1):
        n, m = len(at[t]), len(later)
        now = posterior[at[t]]
        moves += model.follow * (now[:m].T @ later)
        ends = leave[m:n] / (now[m:] * leave[m:n]).sum(axis=1, keepdims=True)
        back = np.concatenate([later @ model.follow.T, ends])
        later = model.emit[tokens[at[t]]] * back / scales[t]
        posterior[at[t]] = now * back
    first = np.empty((len(lengths), STATES))
    first[order] = later
    over = np.flatnonzero(~head)  # moves from one segment of a text to its next
    moves += model.follow * (last[over - 1].T @ first[over])
    emitted = np.stack([np.bincount(tokens, posterior[:, s], CLASSES + 1) for s in range(STATES)], axis=1)
    begin = (np.cumsum(lengths) - lengths)[head]
    return posterior[begin].sum(axis=0), moves, emitted


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths of all segments, number of segments of each text, whether a
    segment is its text's first)."""
    n = -(-lengths // SEGMENT)
    out = np.full(int(n.sum()), SEGMENT)
    out[np.cumsum(n) - 1] = lengths - (n - 1) * SEGMENT
    head = np.zeros(len(out), bool)
    head[np.cumsum(n) - n] = True
    return out, n, head


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows (chunk, counts) of all tasks added up by chunk."""
    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, np.float64) for b in t["counts"].to_pylist()], axis=0)
        return pa.table({"chunk": t["chunk"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = parts.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    return {r.chunk: np.frombuffer(r.counts, np.float64) for r in rows}  # of fixed size in all


def _encoded(texts: DataFrame) -> DataFrame:
    """Table of the classes of each text's tokens (column ``tokens``, two bytes
    each), written once for all passes of the training."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            tokens, lengths = class_sequences(part.column("text"))
            data = tokens.astype(np.int16).tobytes()
            stops = 2 * np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(
                [data[a:b] for a, b in zip(stops - 2 * lengths, stops)], pa.binary())], ["tokens"])

    return save_table(texts.select("text").mapInArrow(run, "tokens binary"))


def _gather(encoded: DataFrame, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, moves, emitted) of ``count(tokens, lengths)`` over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, emitted = np.zeros(STATES + STATES * STATES), np.zeros((CLASSES + 1, STATES))
        seen = False
        for part in text_slices(batches, "tokens", TRAIN_BYTES):
            data, offsets = flat_bytes(part.column("tokens"))
            first, moves, out = count(data.view(np.int16).astype(np.int64), np.diff(offsets) // 2)
            small += np.concatenate([first, moves.ravel()])
            emitted += out
            seen = True
        if seen:
            chunks = [small, *(emitted[a:a + _CHUNK] for a in range(0, CLASSES + 1, _CHUNK))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, len(chunks) - 1), pa.int32()),
                 pa.array([c.tobytes() for c in chunks], pa.binary())], ["chunk", "counts"])

    total = _summed(encoded.select("tokens").mapInArrow(run, "chunk int, counts binary"))
    if not total:
        return np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
    small = total.pop(-1)
    emitted = np.concatenate([total[k] for k in sorted(total)]).reshape(-1, STATES)
    return small[:STATES], small[STATES:].reshape(STATES, STATES), emitted


def train(texts: DataFrame, iterations: int = ITERATIONS) -> tuple[Model, np.ndarray]:
    """(model, tokens of each class) of all given texts (column ``text``)."""
    def tally(tokens, lengths):
        out = np.zeros((CLASSES + 1, STATES))
        out[:, 0] = np.bincount(tokens, minlength=CLASSES + 1)
        return np.zeros(STATES), np.zeros((STATES, STATES)), out

    encoded = _encoded(texts)
    tokens_of = _gather(encoded, tally)[2][:, 0]
    share = (tokens_of + 1) / (tokens_of + 1).sum()
    model = Model.initial(share)
    for _ in range(iterations):
        def count(tokens, lengths, model=model):
            return expected_counts(model, tokens, lengths)
        model = Model.from_counts(*_gather(encoded, count), share)
    return model, tokens_of


# --- counts of the corpus, block by block ----------------------------------

def _lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _block_words(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Words of one block with their number in its training texts."""
    learned, other = Counter(), set()
    for text, held in zip(byte_values(t["text"].combine_chunks()), t["held_out"].to_pylist()):
        words = _lower_words(text)
        if held:
            other.update(words)
        else:
            learned.update(words)
    words = [*learned, *other.difference(learned)]
    n = np.zeros(len(words), np.int64)
    n[:len(learned)] = np.fromiter(learned.values(), np.int64, len(learned))
    return pa.table({"block": pa.array(np.full(len(words), key[0].as_py()), pa.int64()),
                     "word": pa.array(words, pa.binary()), "n": pa.array(n)})


def _words_in_classes(words: DataFrame) -> np.ndarray:
    """Number of distinct words of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES + 1)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(word_classes(batch.column("word").to_pylist()), minlength=CLASSES + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    return _summed(words.select("word").mapInArrow(run, "chunk int, counts binary"))\
        .get(0, np.zeros(CLASSES + 1))


def _score(model: Model, tokens_of: np.ndarray, words_in: np.ndarray, total: int, distinct: int, ends: int):
    """Scores of the documents of one block, given the counts of its words."""
    base_total = np.log10(total + distinct + 1)
    # a class emits one of its words, or an unknown one with the weight of one count
    class_total = np.log10(tokens_of + words_in + 1)
    class_total[END] = 0.0

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, counts: pa.Table) -> pa.Table:
        kept = {name: docs[name] for name in ("doc_id", "held_out")}
        words = counts["word"].to_pylist()
        index = {w: i for i, w in enumerate(words)}
        c = counts["c"].to_numpy().astype(np.int64)
        kind = word_classes(words)
        texts = [_lower_words(b) for b in byte_values(docs["text"].combine_chunks())]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        which = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        row = np.repeat(np.arange(len(texts)), lengths)
        known = np.bincount(row, c[which] > 0, len(texts)).astype(np.int64) + int(ends > 0)
        log_c = np.log10(c + 1)
        base = np.bincount(row, log_c[which], len(texts)) + np.log10(ends + 1) - (lengths + 1) * base_total
        within = np.bincount(row, (log_c - class_total[kind])[which], len(texts))
        tokens = np.full(len(which) + len(texts), END, np.int64)
        tokens[np.arange(len(which)) + row] = kind[which]
        score = within + forward(model, tokens, lengths + 1)
        return pa.table(kept | {
            "n_tokens": pa.array(lengths + 1), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(texts), total)),
            "base_score": pa.array(base), "score": pa.array(score)})
    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    each document, learned from the documents outside the held-out fold.

    Tokens are words (runs of bytes other than ASCII white space, A-Z lowered)
    and one end. Null and empty texts are only an end. Without training texts
    every token is unknown."""
    docs = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    learned = docs.where(~F.col("held_out"))
    model, tokens_of = train(learned)

    sums = docs.agg(F.sum(F.octet_length("text")).alias("bytes"),
                    F.count(F.when(~F.col("held_out"), 1)).alias("ends")).head()
    ends, blocks = sums.ends or 0, (sums.bytes or 0) // BLOCK_BYTES + 1
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).groupBy("block")
    words = dealt.applyInArrow(_block_words, "block long, word binary, n long")
    same = Window.partitionBy("word")
    counts = save_table(words.withColumn("c", F.sum("n").over(same))
                        .withColumn("head", F.min("block").over(same) == F.col("block")).drop("n"))
    words_in = _words_in_classes(counts.where("head and c > 0"))
    distinct = int(words_in.sum()) + int(ends > 0)
    total = int(tokens_of.sum())
    run = _score(model, tokens_of, words_in, total, distinct, ends)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.cogroup(counts.select("block", "word", "c").groupBy("block")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")


def report(docs: DataFrame) -> DataFrame:
    """``score_texts`` of all documents: null and empty texts are only an end,
    repeated rows are scored alike, null ids count as the empty text in the fold,
    an empty table gives an empty one."""
    return score_texts(docs.select("doc_id", "text"))
