import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from routewise.llm import suffix_dedup as sd
from .conftest import make_docs, random_words


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum() if len(b) else 0))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts_with_repeats(seed, length):
    r = random.Random(seed)
    shared = [" ".join(random_words(900 + k, length // 2, 300)) for k in range(3)]
    texts = [None, "", "short", "a" * (length * 2), "a" * (length + 1), "ab" * length, "é" * length,
             "same " * length]
    for k in range(14):
        t = " ".join(random_words(seed * 100 + k, r.randint(10, length), 300))
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            i = r.randrange(len(s) // 2)
            t += s[i:i + r.choice([length - 1, length, length + 1, 2 * length])] + " " + t[:r.randint(0, 50)]
        texts.append(t)
    return texts + texts[-2:]


def spark_rows(spark, texts, length):
    out = sd.remove_repeats(make_docs(spark, texts), length=length)
    return sorted((sum(s.stop - s.start for s in r.removed) + len(r.kept),
                   sum(s.stop - s.start for s in r.removed), len(r.removed),
                   hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())


@pytest.mark.parametrize("seed", range(30))
def test_two_stage_sorting_marks_the_repeats(seed):
    r = random.Random(seed)
    alphabet = ["ab", "a", "abc", "abcdefgh"][seed % 4]
    pieces = ["".join(r.choice(alphabet) for _ in range(r.randint(16, 120))) for _ in range(6)]
    pieces += [p[:r.randint(16, len(p))] for p in pieces[:3]] + ["a" * 40, "b" * 40]
    data = np.frombuffer("".join(pieces).encode(), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    stop = np.repeat(ends, sizes)
    place = np.arange(len(data))
    wanted = place + 16 <= stop
    count = Counter(bytes(data[i:i + 16]) for i in place[wanted])
    want = [bool(wanted[i]) and count[bytes(data[i:i + 16])] > 1 for i in place]
    assert sd.repeated_starts(data, wanted, stop, 16).tolist() == want
    order = sd.two_stage_order(data, wanted, stop, 16, sd.same_strings(data, 16))
    keys = [bytes(data[i:i + 16]) for i in order if wanted[i]]
    assert keys == sorted(keys) and len(keys) == wanted.sum()


def test_window_minima():
    r = np.random.default_rng(1)
    for n, width, top in ((50, 7, 5), (300, 20, 1000), (5, 9, 3), (40, 10, 1)):
        h = r.integers(0, top, n).astype(np.uint64)
        want = [i + int(np.argmin(h[i:i + width])) for i in range(n - width + 1)]
        assert sd.window_minima(h, width).tolist() == want


def test_against_all_substrings(spark, monkeypatch):
    texts = texts_with_repeats(1, 80)
    want = brute(texts, 80)
    assert spark_rows(spark, texts, 80) == want
    monkeypatch.setattr(sd, "HOT_PIECES", 0)  # every anchor is cut into blocks
    assert spark_rows(spark, texts, 80) == want


def test_full_length_given_documents_and_empty(spark, corpus):
    texts = [r.text for r in corpus.limit(120).collect()]
    texts += [texts[3] + "x" * 500, "y" + texts[5], texts[7]]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                 for r in sd.report(make_docs(spark, texts)).collect())
    assert got == brute(texts, sd.LENGTH)
    assert sd.report(make_docs(spark, [])).count() == 0


def test_hot_passage_reaches_no_suffix_array_in_all_its_contexts(spark, monkeypatch):
    passage = " ".join(random_words(5, 200, 300))[:600]
    texts = [" ".join(random_words(1000 + k, 80, 300)) + passage + " ".join(random_words(2000 + k, 80, 300))
             for k in range(60)]
    texts += texts[:2] + [texts[3][:900]]
    most, sort_pieces = 8192, sd._sort_pieces

    def bounded(length):
        def run(batches):
            held, size = [], Counter()
            for b in batches:
                held.append(b)
                for part, copies, piece in zip(*(b.column(c).to_pylist() for c in ("part", "copies", "bytes"))):
                    size[part] += copies * len(piece)
            if max(size.values(), default=0) > most:
                raise ValueError("too many bytes of one part in one suffix array")
            yield from sort_pieces(length)(iter(held))
        return run

    monkeypatch.setattr(sd, "_sort_pieces", bounded)
    monkeypatch.setattr(sd, "HOT_PIECES", 5)
    monkeypatch.setattr(sd, "BLOCK_BYTES", most)
    assert spark_rows(spark, texts, 400) == brute(texts, 400)
