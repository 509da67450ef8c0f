"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
plus signs, digits, "://" and identifier cues. Deterministic parsers then
expand from each anchor to the boundaries of an email address, a network
address, a card or phone number, a URL with credentials or an account number,
and validate what they found.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import list_array, text_slices, with_arrays, with_fields

SLICE_BYTES = 4 << 20
#: Base kinds first, in the order of reports; the last two come from the cues.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

_DIGITS = frozenset(string.digits)
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_PHONE = frozenset(" ().-" + string.digits)
_SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
_AUTHORITY_END = frozenset(" \t\r\n\v\f/?#\"'<>\\^`{|}")
_ALNUM = frozenset(string.ascii_uppercase + string.digits)

#: Words announcing an identifier, and what it must look like.
CUES = {"iban": "iban", "account": "number", "acct": "number", "konto": "number",
        "ssn": "ssn", "social security": "ssn"}
#: Words that may stand between a cue and its number.
FILLERS = ("number", "nummer", "no.", "no", "nr.", "nr", "is", ":", "#", "=")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("url", 3))
    for d in string.digits:
        a.add_word(d, ("0", 1))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def _run(text: str, at: int, chars: frozenset) -> int:
    """End of the run of ``chars`` that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Span around the at-sign at ``at``; nothing before ``floor`` belongs to it."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while text[end:end + 1] == "." and (stop := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = stop, dots + 1
    return (start, end) if dots else None


def addresses(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Four digit runs joined by single dots, each at most 255. Matches that
    fail the limit still use up their text."""
    i = 0
    while i + 3 < len(runs):
        four = runs[i:i + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Chains of digits with at most one space or hyphen between two."""
    i = 0
    while i < len(runs):
        start, end = runs[i]
        n = end - start
        i += 1
        while i < len(runs) and runs[i][0] == end + 1 and text[end] in " -":
            n += runs[i][1] - runs[i][0]
            end = runs[i][1]
            i += 1
        if 13 <= n <= 19 and luhn("".join(c for c in text[start:end] if c in _DIGITS)):
            yield start, end


def phone(text: str, at: int) -> tuple[int, int, int] | None:
    """(start, end, number of digits) of the number that the plus sign opens."""
    if text[at + 1:at + 2] not in _DIGITS or at + 1 >= len(text):
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in _DIGITS:
        return None
    return at, end, sum(c in _DIGITS for c in text[at:end])


def url_credentials(text: str, at: int) -> tuple[int, int] | None:
    """Scheme and authority around "://" where the authority has user:password@."""
    start = at
    while start and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not (text[start].isascii() and text[start].isalpha()):
        start += 1
    end = at + 3
    while end < len(text) and text[end] not in _AUTHORITY_END:
        end += 1
    user, sign, host = text[at + 3:end].rpartition("@")
    name, colon, password = user.partition(":")
    ok = start < at and sign and name and colon and password and host[:1] in _LABEL | {"["}
    return (start, end) if ok and host else None


def _iban(text: str, at: int) -> int:
    """End of a valid IBAN at ``at``, or 0: groups may be set off by single spaces."""
    kept, end = "", at
    best = 0
    while end < len(text) and len(kept) < 34:
        if text[end] in _ALNUM:
            kept += text[end]
            end += 1
            whole = text[end:end + 1] not in _ALNUM or end >= len(text)
            if whole and len(kept) >= 15 and kept[:2].isalpha() and kept[2:4].isdigit() \
                    and int("".join(str(int(c, 36)) for c in kept[4:] + kept[:4])) % 97 == 1:
                best = end
        elif text[end] == " " and kept and text[end - 1] != " ":
            end += 1
        else:
            break
    return best


def account(text: str, at: int, kind: str) -> tuple[int, int] | None:
    """Identifier after a cue that ends at ``at``: an IBAN with right check
    digits, a social security number in its written form, or an account number
    of 8 to 17 digits; at most three filler words stand between."""
    if text[at:at + 1].isalnum():
        return None  # the cue is only part of a word
    for _ in range(4):
        while text[at:at + 1] == " ":
            at += 1
        low = text[at:at + 8].lower()
        filler = next((f for f in FILLERS if low.startswith(f)
                       and not (f[-1].isalpha() and low[len(f):len(f) + 1].isalnum())), None)
        if filler is None:
            break
        at += len(filler)
    if kind == "iban":
        return (at, end) if (end := _iban(text, at)) else None
    end = _run(text, at, _DIGITS | {"-"})
    body = text[at:end].rstrip("-")
    end = at + len(body)
    if text[end:end + 1].isalnum():
        return None
    parts = body.split("-")
    if kind == "ssn":
        ok = [len(p) for p in parts] == [3, 2, 4] and parts[0] not in ("000", "666") \
            and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000"
        return (at, end) if ok else None
    return (at, end) if all(parts) and 8 <= sum(map(len, parts)) <= 17 else None


def spans_of(text: str, anchors) -> list[tuple[int, int, int]]:
    """All spans of a text as (number of the kind, start, end), ordered."""
    out: list[tuple[int, int, int]] = []
    runs: list[tuple[int, int]] = []
    mail_end = phone_end = 0
    for last, (kind, length) in anchors.iter(text):
        at = last - length + 1
        if kind == "0":
            if not runs or at >= runs[-1][1]:
                runs.append((at, _run(text, at, _DIGITS)))
        elif kind == "@":
            if at >= mail_end and (found := email(text, at, mail_end)):
                out.append((0, *found))
                mail_end = found[1]
        elif kind == "+":
            if at >= phone_end and (hit := phone(text, at)):
                phone_end = hit[1]
                if 9 <= hit[2] <= 15:
                    out.append((3, *hit[:2]))
        elif kind == "url":
            if found := url_credentials(text, at):
                out.append((4, *found))
        elif (not at or not text[at - 1].isalnum()) and (found := account(text, last + 1, kind)):
            out.append((5, *found))
    out += [(1, *s) for s in addresses(text, runs)]
    out += [(2, *s) for s in cards(text, runs)]
    return sorted(set(out))


SPAN = T.StructType([T.StructField("kind", T.StringType()),
                     T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def find_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``spans``: array of (kind, start, end), code points, end
    exclusive, ordered by kind as in KINDS and by start. Spans of a base
    kind do not overlap, those of two kinds, of url and of account may. Null and empty texts have none; a
    column ``spans`` already there is replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        names = np.array(KINDS, dtype=object)
        for part in text_slices(batches, text, SLICE_BYTES):
            found = [spans_of(t, anchors) if t else [] for t in part.column(text).to_pylist()]
            flat = np.array([s for f in found for s in f], np.int64).reshape(-1, 3)
            values = pa.StructArray.from_arrays(
                [pa.array(names[flat[:, 0]].tolist(), pa.string()),
                 pa.array(flat[:, 1], pa.int32()), pa.array(flat[:, 2], pa.int32())],
                ["kind", "start", "end"])
            yield with_arrays(part, spans=list_array(values, np.array([len(f) for f in found])))

    return df.mapInArrow(run, with_fields(df.schema, ("spans", T.ArrayType(SPAN))))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the found spans of ``text`` replaced by [kind] marks; of
    overlapping spans the one that starts first (then the longer one) stays."""
    @F.pandas_udf("string")
    def marked(texts, spans):
        out = []
        for t, found in zip(texts, spans):
            if t is None or found is None or not len(found):
                out.append(t)
                continue
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [t[at:s["start"]], f"[{s['kind']}]"]
                    at = s["end"]
            out.append("".join([*parts, t[at:]]))
        import pandas as pd
        return pd.Series(out, dtype=object)

    return find_spans(df, text).withColumn(text, marked(F.col(text), F.col("spans"))).drop("spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts by base kind, digest of the base spans, all spans."""
    found = find_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS),
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
