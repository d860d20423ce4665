"""Personal data by candidate spans and boosted trees.

Base kinds have exact rules and always stay: email, ip, card, phone. Beside
them, generators with high recall propose spans that may overlap (values of
assignments, long mixed strings, long digit groups, national phones, IBANs,
parts of digit runs too long for one card); gradient-boosted trees
judge each by its format and its context, and a threshold calibrated on
held-back candidates selects. The trees learn from a bounded sample: candidates
with the format of a card, an IBAN, a social security number or a national phone,
or that a naming word assigns, are examples; other digit groups and strings
without such context are counterexamples.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.llm.boosting import BoostedTrees
from clientlens.llm.common import map_batches

# The base rules.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret", "number")

SAMPLE_DOCUMENTS = 30_000  # expected number of documents whose candidates may train
SAMPLE_CANDIDATES = 20_000  # of them are used
_TRIGGER = re.compile(r"[0-9@]")
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_MIXED = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGITS = re.compile(r"[0-9](?:[ .-]?[0-9]){8,}")
_ASSIGNED = re.compile(r"[A-Za-z]\w*[\"']?\s*$")
_ASSIGN = re.compile(r"[:=]+")
_VALUE = re.compile(r"\s{0,4}(?:\"([^\"\n]{4,4096})\"|'([^'\n]{4,4096})'|([^\s\"'<>,;(){}\[\]/][^\s\"'<>,;(){}\[\]]{3,4096}))")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?[ ./-]?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,3}(?![0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}")
_LOCAL = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}")
_NAMED = re.compile(r"(?i)(?:(?:token|secret|passw|passphrase)\w{0,10}|(?:pwd|api[_-]?key|key|auth)s?(?:[_-]\w{1,10})?)[\"']?\s*[:=]+\s*[\"']?$")
_NUMBERED = re.compile(r"(?i)(?<![a-z])(?:account|acct|iban|ssn|social security|(?:credit |debit )?card|phone|tel|telephone|mobile|fax|passport)"
                       r"(?:[ _-]?(?:number|no|nr|id))?[\"']?[.:=# ]{0,4}[\"'(+]{0,2}$")
_WORDS = re.compile(r"(?i)token|secret|passw|key|auth|account|iban|ssn|card|phone|tel")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind and start: leftmost, non-overlapping per kind; failing matches are dropped."""
    spans: list[Span] = []
    if not _TRIGGER.search(text):
        return spans
    at = text.find("@")
    while at >= 0:  # a match lies within one run of the characters it may have
        start = at
        while start and _EMAIL_RUN.match(text[start - 1]):
            start -= 1
        end = _EMAIL_RUN.match(text, at).end()
        spans.extend(("email", m.start(), m.end()) for m in EMAIL.finditer(text, start, end))
        at = text.find("@", end)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def _card_parts(run: str) -> list[tuple[int, int]]:
    """Parts of a run of digits and separators that is too long for one card: 16 to 19 digits between two
    separators, and, of digits without one, every 16 from either end."""
    places = [i for i, c in enumerate(run) if c in "0123456789"]
    n, parts = len(places), set()
    starts = [k for k in range(n) if not k or places[k] - places[k - 1] > 1]
    ends = {*starts[1:], n}
    for k in starts:
        parts |= {(k, k + size) for size in range(16, 20) if k + size in ends}
    for first, last in zip(starts, [*starts[1:], n], strict=True):
        if last - first > 19:
            parts |= {(k, k + 16) for k in range(first, last - 15, 16)} | {(k - 16, k) for k in range(last, first + 15, -16)}
    return [(places[a], places[b - 1] + 1) for a, b in sorted(parts)]


def _iban(value: str) -> bool:
    spelled = value.replace(" ", "")
    return 15 <= len(spelled) <= 34 and int("".join(str(int(c, 36)) for c in spelled[4:] + spelled[:4])) % 97 == 1


def _format(value: str) -> int:
    """Which format of personal numbers a whole value has: card, IBAN, social security, national phone, or none (0)."""
    digits = "".join(c for c in value if c in "0123456789")
    if 16 <= len(digits) <= 19 and CARD.fullmatch(value) and len(set(digits)) > 1 and _luhn(digits):
        return 1
    if _IBAN.fullmatch(value) and _iban(value):
        return 2
    return 3 if _SSN.fullmatch(value) else 4 if _LOCAL.fullmatch(value) else 0


def candidates(text: str) -> list[Span]:
    """Proposed spans beyond the base kinds, each once; they may overlap each other and base spans."""
    found: dict[Span, None] = {}
    for m in _ASSIGN.finditer(text):
        if _ASSIGNED.search(text[max(0, m.start() - 24):m.start()]) and (value := _VALUE.match(text, m.end())):
            found["secret", *value.span(value.lastindex)] = None
    if not _TRIGGER.search(text):
        return list(found)
    for m in _MIXED.finditer(text):
        if any(c in "0123456789" for c in m.group()) and any(c.isalpha() for c in m.group()):
            found["secret", m.start(), m.end()] = None
    for pattern in (_DIGITS, _NATIONAL):
        for m in pattern.finditer(text):
            if sum(c in "0123456789" for c in m.group()) >= 7:
                found["number", m.start(), m.end()] = None
    for m in CARD.finditer(text):
        if m.end() - m.start() > 19:
            for start, end in _card_parts(m.group()):
                found["number", m.start() + start, m.start() + end] = None
    for m in _IBAN.finditer(text):
        end = next((e for e in range(m.end(), m.start() + 14, -1) if text[e - 1] != " " and _iban(text[m.start():e])), None)
        if end:
            found["number", m.start(), end] = None
    return list(found)


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    kind, start, end = span
    value, before, after = text[start:end], text[max(0, start - 32):start], text[end:end + 2]
    n = len(value)
    counts = Counter(value)
    digits = sum(c in "0123456789" for c in value)
    letters = sum(c.isalpha() for c in value)
    changes = sum((a in "0123456789") != (b in "0123456789") for a, b in zip(value, value[1:], strict=False))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return [float(kind == "secret"), n, digits / n, letters / n, sum(c in "0123456789abcdef" for c in value) / n,
            sum(c.isupper() for c in value) / n, entropy, changes / n, n - digits - letters,
            float(before[-1:] in "\"'" and bool(before)), float(after[:1] in "\"'" and bool(after)),
            float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(bool(_WORDS.search(before))), float(_luhn("".join(
                c for c in value if c in "0123456789"))),
            float(_format(value)) if kind == "number" else 0.0, float(bool((_NUMBERED if kind == "number" else _NAMED).search(before)))]


def _example(text: str, span: Span) -> int:
    """What format and naming words say about a candidate, whether or not a base rule accepts it too."""
    kind, start, end = span
    before = text[max(0, start - 32):start]
    if kind == "number":
        return int(_format(text[start:end]) > 0 or bool(_NUMBERED.search(before)) and end - start <= 42)
    return int(bool(_NAMED.search(before)))


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, limit: int = SAMPLE_CANDIDATES) -> BoostedTrees:
    """Trees from the candidates of about ``sample`` documents, ``limit`` at most, chosen by a hash of the text."""
    texts = docs.where("text IS NOT NULL").select("text")
    share = sample / max(1, docs.count())
    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(share * 1_000_003)) if share < 1 else texts

    def examples(batches) -> Iterable:
        for batch in batches:
            x, y = [], []
            for text in batch.column(0).to_pylist():
                proposed = candidates(text)
                x += [features(text, span) for span in proposed]
                y += [_example(text, span) for span in proposed]
            yield x, y

    rows = (map_batches(picked, examples, "x array<double>, y int")
            .orderBy(F.xxhash64("x"), "x", "y").limit(limit).collect())
    model = BoostedTrees()
    return model.fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])) if rows else model


def spans_of(text: str | None, model: BoostedTrees) -> list[Span]:
    """Base spans by kind and start, then the selected extra spans likewise; extra spans overlap no base span
    and, of a kind, not each other."""
    if not text:
        return []
    base = base_spans(text)
    if model.threshold > 1:
        return base
    proposed = [(k, s, e) for k, s, e in candidates(text) if not any(s < y and x < e for _, x, y in base)]
    if not proposed:
        return base
    p = model.probabilities(np.array([features(text, span) for span in proposed]))
    taken: dict[str, list[tuple[int, int]]] = {kind: [] for kind in EXTRA}  # of each kind apart and in order
    for value, (kind, start, end) in sorted(zip(p, proposed, strict=True), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
        if value >= model.threshold:
            at = bisect(taken[kind], (start, end))
            if (not at or taken[kind][at - 1][1] <= start) and (at == len(taken[kind]) or taken[kind][at][0] >= end):
                taken[kind].insert(at, (start, end))
    chosen = [(kind, *place) for kind, places in taken.items() for place in places]
    return base + sorted(chosen, key=lambda span: (EXTRA.index(span[0]), span[1]))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every run of overlapping spans replaced by the kind of its first span."""
    if not spans:
        return text
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: BoostedTrees, derive: Callable[[list[Span]], tuple] | None = None,
         derived: str = "") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every whole text.

    ``derive`` turns the spans of a text into the columns named in ``derived``
    instead. A null or empty text has no spans; repeated rows give repeated
    rows, an empty table gives none; columns other than doc_id and text are not
    read.
    """
    finish = derive or (lambda spans: ([{"kind": k, "start": s, "end": e} for k, s, e in spans],))

    def run(batches) -> Iterable:
        for batch in batches:
            rows = [finish(spans_of(text, model)) for text in batch.column(1).to_pylist()]
            yield [batch.column(0), *map(list, zip(*rows, strict=True))] if rows else [[]]

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, " + (derived or "spans array<struct<kind: string, start: int, end: int>>"))


def redact_text(model: BoostedTrees) -> Column:
    """The column ``text`` with its spans replaced."""
    @F.pandas_udf("string")
    def redact(text: pd.Series) -> pd.Series:
        return text.map(lambda t: redacted(t, spans_of(t, model)), na_action="ignore")

    return redact("text")
