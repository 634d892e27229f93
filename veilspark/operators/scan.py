"""The entities of one text, in plain Python: what :mod:`detect`'s column functions give, at a fraction of their time.

A text has dozens of candidates, and column functions on arrays are interpreted for each of them; here a text costs one pass a
pattern and a few substring tests a candidate.  Tests hold both ways to the same entities.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from calendar import monthrange
from collections.abc import Iterator

from ..functions import patterns as P
from ..functions import words as W
from ..functions.patterns import least_words
from . import text_rules as R
from .validators import INN10, INN12_A, INN12_B

# Scores and reach of the context.
MIN_SCORE = 0.5
BOOST, SUPPRESS = 0.35, 0.6
WINDOW = 20
CARD_NEAR, CARD_BOOST = 60, 0.4


def _compiled(pattern: str) -> re.Pattern:
    """An RE2 pattern for normalized text, where all white space is single spaces; an end is the end of the text."""
    return re.compile(re.sub(r"\$(?=\)|$)", r"\\Z", pattern), re.ASCII)


_EMAIL, _PHONE, _INN, _CARD, _PIN, _HOLDER, _PASSPORT, _SPLIT, _DEPARTMENT, _LICENCE, _ISSUER, _NUMERIC, _ISO, _NAMED, _YEAR = map(
    _compiled,
    (P.EMAIL, P.PHONE, P.INN, P.CARD_NUMBER, P.PIN, P.CARDHOLDER_NAME, P.PASSPORT, P.PASSPORT_SPLIT, P.DEPARTMENT_CODE, P.DRIVER_LICENSE, P.PASSPORT_ISSUER, P.DATE_NUMERIC, P.DATE_ISO, P.DATE_WORDS, P.YEAR),
)
_DIGIT = re.compile("[0-9]")
_GUARD = re.compile(R.GUARD)
_RUN = re.compile(f"[{P.SPACES}]{{2,}}")
_HOLDER_WORDS = least_words(W.CARDHOLDER_KEYWORDS)


def inn_fits(v: str) -> bool:
    """Control digits of 10- or 12-digit tax numbers; all digits alike never pass."""
    d = list(map(int, v))
    control = lambda weights: sum(a * b for a, b in zip(d, weights)) % 11 % 10
    return len(set(d)) > 1 and (control(INN10) == d[9] if len(d) == 10 else control(INN12_A) == d[10] and control(INN12_B) == d[11])


def card_fits(v: str) -> bool:
    """16 digits that pass the Luhn check and are not all alike; spaces and hyphens do not count."""
    d = [int(c) for c in v if c not in " -"]
    return len(set(d)) > 1 and sum(sum(divmod(2 * c, 10)) if i % 2 == 0 else c for i, c in enumerate(d)) % 10 == 0


def date_fits(year: str, month: str, day: str) -> bool:
    y, m = int(year), int(month)
    return len(year) == 4 and 1900 <= y <= 2100 and 1 <= m <= 12 and 1 <= int(day) <= monthrange(y, m)[1]


def candidates(t: str, rules) -> Iterator[tuple[str, int, int, float, tuple[str, ...], int]]:
    """``(type, s, e, score, sources, reg)`` of all recognizers, by registry order and then place.  ``rules``: the walking ones."""
    at = lambda rx: [m.span() for m in rx.finditer(t)]
    rx, rc, rf, ctx = ("regex",), ("regex", "checksum"), ("regex", "format"), ("regex", "context")
    digits = _DIGIT.search(t) is not None
    if "@" in t:
        yield from (("EMAIL", s, e, 0.6, rx, 0) for s, e in at(_EMAIL))
    if digits:
        yield from (("PHONE", s, e, 0.6, rx, 1) for s, e in at(_PHONE))
        yield from (("INN", s, e, 0.9, rc, 2) for s, e in at(_INN) if inn_fits(t[s:e]))
        yield from (("CARD_NUMBER", s, e, 0.4, rc, 3) for s, e in at(_CARD) if card_fits(t[s:e]))
        yield from (("PIN", s, e, 0.3, rx, 5) for s, e in at(_PIN))
    # a run of Latin words reaches the least score only with one of these words near it
    if any(w in t for w in _HOLDER_WORDS):
        yield from (("CARDHOLDER_NAME", s, e, 0.3, rx, 6) for s, e in at(_HOLDER) if " " in t[s:e].strip(" "))
    if digits:
        yield from (("PASSPORT", s, e, 0.4, rf, 7) for s, e in at(_PASSPORT))
        if "серия" in t:
            yield from (("PASSPORT", s, e, 0.7, rf, 7) for s, e in at(_SPLIT))
        yield from (("DEPARTMENT_CODE", s, e, 0.4, rf, 8) for s, e in at(_DEPARTMENT))
        yield from (("DRIVER_LICENSE", s, e, 0.4, rf, 9) for s, e in at(_LICENCE))
    if "выда" in t:
        yield from (("PASSPORT_ISSUER", *m.span(1), 0.7, ctx, 10) for m in _ISSUER.finditer(t))
    if digits:
        numeric, iso, named = at(_NUMERIC), at(_ISO), at(_NAMED)
        for s, e in numeric:
            d, m, y = re.split(r"[./\-]", t[s:e])
            if date_fits(y, m, d):
                yield "BIRTH_DATE", s, e, 0.4, rf, 11
        yield from (("BIRTH_DATE", s, e, 0.4, rf, 11) for s, e in iso if date_fits(*t[s:e].split("-")))
        yield from (("BIRTH_DATE", s, e, 0.45, rf, 11) for s, e in named)
        every = numeric + iso + named
        yield from (("BIRTH_DATE", s, e, 0.3, rf, 11) for s, e in at(_YEAR) if not any(s < z and a < e for a, z in every))
    if _GUARD.search(t):
        yield from rules(t)


def evidence(sources: tuple[str, ...]) -> int:
    """Strength by kind of proof: checksum with context 5, checksum 4, dictionary with context 3, dictionary or context 2, else 1."""
    if "checksum" in sources:
        return 5 if "context" in sources else 4
    if "dictionary" in sources:
        return 3 if "context" in sources else 2
    return 2 if "context" in sources else 1


class Scanner:
    """Entities of texts, by the tables of what raises and lowers a type's score and by the walking ``rules``."""

    def __init__(self, positive, negative, issue, licence, rules):
        few = lambda where, words: (None if where == "around" else where, least_words(words))
        self.positive = {kind: few(*x) for kind, x in positive.items()}
        self.negative = {kind: [[few(*x) for x in group] for group in groups] for kind, groups in negative.items()}
        self.issue, self.licence, self.rules = few(*issue), few(*licence), rules

    @staticmethod
    def _has(t: str, s: int, e: int, where: int | None, words: tuple[str, ...]) -> bool:
        near = t[max(s - WINDOW, 0) : e + WINDOW] if where is None else t[max(s - where, 0) : s]
        for w in words:  # a loop, as it runs for every candidate
            if w in near:
                return True
        return False

    def scored(self, t: str, c: tuple) -> tuple:
        """``(type, s, e, score, sources, reg, ctx)``: a candidate as the context leaves it; ``ctx`` tells that a word spoke for it."""
        kind, s, e, score, sources, reg = c
        ctx = kind in self.positive and self._has(t, s, e, *self.positive[kind])
        if kind == "BIRTH_DATE" and self._has(t, s, e, *self.issue):
            kind, ctx = "PASSPORT_ISSUE_DATE", True
        elif kind == "PASSPORT" and self._has(t, s, e, *self.licence):
            kind, ctx = "DRIVER_LICENSE", True
        boost = BOOST if ctx else 0.0
        for group in self.negative.get(kind, ()):
            if any(self._has(t, s, e, *g) for g in group):
                boost -= SUPPRESS
        if kind == "PASSPORT":
            before = t[max(s - 60, 0) : s]
            if "номер документа" in before and "паспорт" not in before:
                boost -= SUPPRESS
        return kind, s, e, max(0.0, min(1.0, score + boost)), sources, reg, ctx

    def resolved(self, t: str, min_score: float) -> list[tuple[int, int, str, float]]:
        """``(s, e, type, score)`` in the normalized text, disjoint: from the left, of two that overlap the stronger stays."""
        every = [self.scored(t, c) for c in candidates(t, self.rules)]
        cards = [(s, e) for kind, s, e, score, *_ in every if kind == "CARD_NUMBER" and score >= MIN_SCORE]
        strong = []
        for kind, s, e, score, sources, reg, ctx in every:
            # codes that context already speaks for gain from a card number within 60 characters
            if ctx and kind in ("CVV", "PIN") and any(max(a - e, s - z, 0) <= CARD_NEAR for a, z in cards):
                score, sources = min(1.0, score + CARD_BOOST), (*sources, "context")
            if score >= min_score:
                strong.append((s, -evidence(sources), -score, reg, len(strong), e, kind, score))
        out: list[tuple] = []
        for c in sorted(strong):
            last = out[-1] if out else None
            if last is None or not (c[0] < last[5] and last[0] < c[5]):
                out.append(c)
            elif c[1:3] < last[1:3]:
                out[-1] = c
        return [(c[0], c[5], c[6], c[7]) for c in out]

    def entities(self, text: str, norm: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, str, float]]:
        """``(type, s, e, text, score)`` at code points of ``text``."""
        found = self.resolved(norm, min_score)
        if not found:
            return []
        at, gone = [-1], [0]
        for m in _RUN.finditer(text) if len(text) != len(norm) else ():
            at.append(m.start() + 1 - gone[-1])
            gone.append(gone[-1] + m.end() - m.start() - 1)
        place = lambda i: i + gone[bisect_right(at, i) - 1]
        out = []
        for s, e, kind, score in found:
            a, z = place(s), place(e - 1) + 1
            out.append((kind, a, z, text[a:z], score))
        return out
