"""Language identification with string kernels.

The kernel is the blended-spectrum presence kernel: the number of character
n-grams (n = 1 to 3) that two texts share, each counted once, divided by the
geometric mean of their own numbers. Landmark texts give Nystroem features,
one-versus-rest kernel ridge regression on them is solved from normal
equations summed over all tasks, and texts are scored in batches: a matrix of
n-gram presence times the landmarks' presence gives the kernel values, times
the weights the classes' values.

Texts are read as symbols: letters lowered, the ALPHABET most frequent letters
of the landmarks keep symbols of their own, all other letters share one, and a
run of anything else is one blank. Whole texts are read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import opened, remainder, sealed, sealed_name, text_slices, with_arrays, with_fields

UNKNOWN = "und"
#: n-gram orders and symbols; symbols 0 and 1 are blank and any other letter.
ORDERS = (1, 2, 3)
ALPHABET = 126
BITS = 7
#: Bounds of the labelled sample: landmarks and training texts for each language.
LANDMARKS = 32
TRAIN = 1000
#: Tasks that sum the normal equations of the sample.
FIT_TASKS = 16
#: Weight of the squared norm against the mean squared error.
RIDGE = 1e-3
#: A text in a learned language has at least this part of the usual share of
#: longest n-grams that its landmarks have.
LEAST_SHARE = 0.5
#: Texts scored by one matrix product, and bytes of texts held at a time.
BATCH = 64
SLICE_BYTES = 4 << 20

_CODES = 0x110000
_CODE_SPACE = sum(1 << BITS * n for n in ORDERS)
#: First code of the longest n-grams.
_LONGEST = sum(1 << BITS * n for n in ORDERS[:-1])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_table() -> np.ndarray:
    """Per code point: 1 for letters (any letter symbol), 0 for the rest."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(_CODES)),
                       np.uint8, _CODES)


def symbol_table(letters: np.ndarray, texts: list[str]) -> np.ndarray:
    """Code point to symbol, from the letters' frequency in ``texts``."""
    count: Counter[str] = Counter()
    for t in texts:
        count.update(t.lower())
    table = letters.copy()
    ranked = sorted((-n, c) for c, n in count.items() if letters[ord(c)])
    for symbol, (_, c) in enumerate(ranked[:ALPHABET], 2):
        table[ord(c)] = symbol
    return table


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a text, repeats included."""
    symbols = table[code_points(text)].astype(np.int32)
    symbols = np.concatenate([[0], symbols, [0]]).astype(np.int32)  # a blank at both ends
    symbols = symbols[(symbols > 0) | np.append(True, symbols[:-1] > 0)]  # one for a run
    parts, code, base = [], symbols, 0
    for n in ORDERS:
        if n > 1:
            code = (code[:-1] << BITS) + symbols[n - 1:]
        parts.append(code + base)
        base += 1 << BITS * n
    return np.concatenate(parts)


@dataclass
class Landmarks:
    table: np.ndarray      # code point -> symbol
    column: np.ndarray     # n-gram code -> column of the presence matrix, last: no landmark has it
    presence: np.ndarray   # n-grams x landmarks, scaled by each landmark's own number
    languages: list[str]

    @classmethod
    def of(cls, texts: list[str], languages: list[str]) -> Landmarks:
        table = symbol_table(letter_table(), texts)
        sets = [np.unique(grams(t, table)) for t in texts]
        known = np.unique(np.concatenate(sets))
        column = np.full(_CODE_SPACE, len(known), np.int32)
        column[known] = np.arange(len(known))
        presence = np.zeros((len(known) + 1, len(texts)), np.float32)
        for k, s in enumerate(sets):
            presence[column[s], k] = 1 / np.sqrt(len(s))
        return cls(table, column, presence, languages)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values (texts x landmarks) as one matrix product."""
        rows = np.zeros((len(texts), len(self.presence)), np.float32)
        own = np.ones(len(texts), np.float32)
        seen = np.zeros(_CODE_SPACE, bool)
        for row, (k, t) in zip(rows, enumerate(texts)):
            codes = grams(t, self.table)
            seen[codes] = True
            own[k] = max(1, np.count_nonzero(seen))
            seen[codes] = False
            row[self.column[codes]] = 1
        rows[:, -1] = 0
        return (rows @ self.presence) / np.sqrt(own)[:, None]


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray    # landmarks (and a constant) x languages
    languages: list[str]
    seen: np.ndarray       # columns of the presence matrix x languages: a landmark of it has the n-gram
    least: np.ndarray      # per language: smallest share of longest n-grams it must have seen

    def values(self, texts: list[str]) -> np.ndarray:
        k = self.landmarks.kernel(texts).astype(np.float64)
        return np.hstack([k, np.ones((len(k), 1))]) @ self.weights

    def known(self, text: str, best: int) -> bool:
        """Whether the landmarks of a learned language have enough of the text's
        longest n-grams; a short text may get its best value elsewhere. Each
        language is judged by itself, so their number does not matter. A language
        without a measure (one landmark) takes what has its best value there."""
        codes = np.unique(grams(text, self.landmarks.table))
        codes = codes[codes >= _LONGEST]
        if not len(codes):
            return False
        share = self.seen[self.landmarks.column[codes]].mean(axis=0)
        return bool(((self.least > 0) & (share >= self.least)).any() or self.least[best] == 0)


def _seen_shares(landmarks: Landmarks, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(seen, least) of a model: n-grams by language, and LEAST_SHARE of the median
    share of a landmark's longest n-grams that others of its language have."""
    has = landmarks.presence > 0
    count = np.zeros((len(has), n), np.int32)
    for k, language in enumerate(of):
        count[has[:, k], language] += 1
    longest = np.zeros(len(has), bool)
    columns = landmarks.column[_LONGEST:]
    longest[columns[columns < len(has) - 1]] = True
    shares: list[list[float]] = [[] for _ in range(n)]
    for k, language in enumerate(of):
        mine = has[:, k] & longest
        if mine.any():
            shares[language].append(float((count[mine, language] > 1).mean()))
    return count > 0, np.array([LEAST_SHARE * float(np.median(x)) if x else 0.0 for x in shares])


def _sample(labelled: DataFrame, lang: str, key: list[str], counts: dict[str, int],
            per_language: int, seed: int) -> DataFrame:
    """About ``per_language`` rows of each language, chosen by a hash of the id."""
    share = F.create_map(*[F.lit(v) for name, n in counts.items()
                           for v in (name, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.where(draw < share[F.col(lang)])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fits on a bounded sample of the rows with a language and a letter:
    about LANDMARKS + TRAIN texts for each language, chosen by a hash of the key."""
    rows = labelled.where(F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        raise ValueError("no labelled rows to learn from")
    rows = rows.where(has_letter(F.col("text")))
    chosen = _sample(rows, "lang", ["key"], counts, LANDMARKS, 1).select("lang", "text") \
        .distinct().orderBy("lang", "text").collect()
    if not chosen:  # few labelled rows: all of them
        chosen = rows.select("lang", "text").distinct().orderBy("lang", "text") \
            .limit(LANDMARKS * len(counts)).collect()
    languages = sorted({r.lang for r in chosen} | set(counts))
    landmarks = Landmarks.of([r.text for r in chosen] or [""], languages)
    number = {name: k for k, name in enumerate(languages)}
    m, c = landmarks.presence.shape[1] + 1, len(languages)

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m + c))
        count = 0
        for part in text_slices(batches, "text", SLICE_BYTES):
            texts = part.column("text").to_pylist()
            target = np.array([number[v] for v in part.column("lang").to_pylist()])
            for at in range(0, len(texts), BATCH):
                k = landmarks.kernel(texts[at:at + BATCH]).astype(np.float64)
                x = np.hstack([k, np.ones((len(k), 1))])
                total += x.T @ np.hstack([x, np.eye(c)[target[at:at + BATCH]]])
                count += len(k)
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([count], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))],
                ["n", "total"])

    # the sample is of bounded size: a fixed number of tasks, and so of sums, serves it
    parts = _sample(rows, "lang", ["key"], counts, TRAIN, 2).select("lang", "text").repartition(FIT_TASKS) \
        .mapInArrow(normal_equations, "n long, total array<double>").collect()
    if not parts:
        parts = rows.orderBy("key", "text").limit(TRAIN).select("lang", "text") \
            .mapInArrow(normal_equations, "n long, total array<double>").collect()
    n = sum(p.n for p in parts)
    total = sum((np.array(p.total).reshape(m, m + c) for p in parts), np.zeros((m, m + c)))
    # ridge in the space of the landmarks: the norm of a function is w' K w
    gram = landmarks.kernel([r.text for r in chosen] or [""]).astype(np.float64)
    penalty = np.zeros((m, m))
    penalty[:-1, :-1] = (gram + gram.T) / 2 + 1e-8 * np.eye(m - 1)
    weights = np.linalg.lstsq(total[:, :m] + RIDGE * max(n, 1) * penalty, total[:, m:], rcond=1e-12)[0]
    of = np.array([number[r.lang] for r in chosen], np.int64)
    return Model(landmarks, weights, languages, *_seen_shares(landmarks, of, c))


def predict(df: DataFrame, model: Model, text: str = "text", judge: bool = False) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and, to ``judge`` them, ``known``. Texts that are null or
    without a letter get ``und``, 0 and false; else the language with the highest
    value (ties: the first by name), the score being that value between 0 and 1,
    and whether the text's n-grams are those of a learned language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, dtype=object)
        letters = letter_table().astype(bool)
        for part in text_slices(batches, text, SLICE_BYTES):
            texts = part.column(text).to_pylist()
            lang = np.full(len(texts), UNKNOWN, dtype=object)
            score = np.zeros(len(texts))
            known = np.zeros(len(texts), bool)
            usable = np.array([k for k, t in enumerate(texts)
                               if t and letters[code_points(t)].any()], np.int64)
            for at in range(0, len(usable), BATCH):
                rows = usable[at:at + BATCH]
                values = model.values([texts[k] for k in rows])
                best = values.argmax(axis=1)
                lang[rows] = names[best]
                score[rows] = np.clip(values[np.arange(len(rows)), best], 0, 1)
                if judge:
                    known[rows] = [model.known(texts[k], b) for k, b in zip(rows, best)]
            more = {"known": pa.array(known)} if judge else {}
            yield with_arrays(part, lang_pred=pa.array(lang.tolist(), pa.string()),
                              score=pa.array(score), **more)

    return df.mapInArrow(run, with_fields(df.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()),
                                          *([("known", T.BooleanType())] if judge else [])))


#: Fold of documents that are never learned from: remainder 2 of 4.
FOLDS, HELD_OUT = 4, 2


def held_out() -> Column:
    return remainder(F.col("doc_id"), FOLDS) == HELD_OUT


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents in a learned language: not ``und``, and with n-grams that the
    landmarks of a language have (Model.known). The score rejects nothing: the
    best value falls with the number of languages. Null and letterless texts go;
    repeated rows are judged alike; without labels every text with a letter
    stays; an empty table gives an empty one. Columns stay as they are."""
    learned = docs.where(~held_out())
    if learned.where(F.col("lang").isNotNull()).isEmpty():
        return docs.where(has_letter(F.col("text")))  # nothing to learn from
    model = fit(learned)
    judged = predict(sealed(docs), model, sealed_name(docs, "text"), judge=True)
    return opened(judged.where("known"), docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Learns from the documents outside the held-out fold, predicts all. With no
    label to learn from, all are ``und`` with 0."""
    learned = docs.where(~held_out())
    if learned.where(F.col("lang").isNotNull()).isEmpty():
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"))
    model = fit(learned)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
