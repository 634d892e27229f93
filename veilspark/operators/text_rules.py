"""Recognizers that walk over a text: CVV, citizenship, birth place, full name and address.

They are Arrow-batched: each is a left-to-right scan with lookups, which built-in functions express only by folds that are far
slower.  Results are code-point positions in the normalized text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.patterns import BIRTH_PLACE

FOUND = "array<struct<type:string,s:int,e:int,score:double,sources:array<string>,reg:int>>"
#: A text without these has none of the five.
GUARD = "[а-яё]|cv[vc]"

# Words that bind or separate values.
CVV_SIGNATURES = (
    "три цифры на обороте карты", "код с обратной стороны", "код на обороте", "код безопасности", "защитный код",
    "трёхзначный код", "трехзначный код", "cvv2", "cvc2", "cvv", "cvc", "цвв", "цвс", "свв", "свс",
)
CVV_COMPETING = (
    "сумма", "цена", "рублей", "руб", "стоимость", "₽", "оплата", "платеж", "платёж", "заказ", "заявка", "артикул", "договор",
    "sms", "otp", "одноразовый", "код подтверждения", "смс", "ошибка", "http", "код ошибки",
    "кабинет", "аудитория", "комната", "офис", "помещение", "домофон", "замок", "сейф", "кодовый замок", "шкафчик", "ячейка",
    "телефон", "дом", "квартира", "пин", "pin", "дата", "срок действия", "срок",
)
ADDRESS_SIGNATURES = (
    "адрес фактического проживания", "адрес фактической регистрации", "адрес проживания", "адрес регистрации", "адрес доставки",
    "место жительства", "место регистрации", "проживает по адресу", "живет по адресу", "живёт по адресу",
    "зарегистрирован по адресу", "зарегистрирована по адресу", "прописан по адресу", "прописана по адресу", "адрес",
)
ADDRESS_NEXT = (
    "телефон", "тел", "email", "e-mail", "инн", "паспорт", "гражданство", "дата", "cvv", "пин", "покупатель", "получатель",
    "сумма", "договор", "фио", "ф.и.о", "код", "номер карты",
)
PLACE_ENDS = (
    ", дата рождения", ", дата", ", паспорт", ", гражданство", ", граждан", ", тел", ", телефон", ", email", ", e-mail", ", инн",
    ", фио", ", ф.и.о", ", код", ", адрес", ", номер карты", ", cvv", ", пин",
)
PATRONYMIC = ("ович", "евич", "овна", "евна", "ична", "ич", "чна")
SURNAME = ("ов", "ев", "ин", "ын", "ский", "ской", "цкий", "цкой", "ова", "ева", "ина", "ына", "ская", "цкая")
COUNTRY_ENDS = (("ии", "ия"), ("ией", "ия"), ("ию", "ия"), ("е", "а"), ("е", "я"))
COUNTRY_CASES = ("ов", "ев", "ин", "ын", "ии", "ой", "ий", "ый", "а", "я", "е", "у", "ом", "ем")


def _bounded(words: tuple[str, ...]) -> re.Pattern:
    """Any of the words where no letter or digit touches it, the longest first; overlapping ones are all found."""
    by_length = "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
    return re.compile(rf"(?=((?<![^\W_])(?:{by_length})(?![^\W_])))")


_CVV_SIGN, _ADDRESS_SIGN, _ADDRESS_STOP = _bounded(CVV_SIGNATURES), _bounded(ADDRESS_SIGNATURES), _bounded((*ADDRESS_SIGNATURES, *ADDRESS_NEXT))
_COMPETING = re.compile("|".join(map(re.escape, CVV_COMPETING)))
_DIGIT_RUN = re.compile("\\d[\\d \\t\\-\\u200b\\u200c\\u200d\\ufeff\\u2060]*")
_PLACE = re.compile(BIRTH_PLACE, re.ASCII)  # white space is single spaces by now
_PLACE_KEYS = ("место рождения", "роди", "урожен", "родом из")  # each way of its beginning has one
_NAME_WORD = re.compile("[а-яёa-z]+")
_PUNCTUATION = ".,;:!?()[]{}«»\"'"
_STRONG = re.compile(r"[,;.!?\n\r]")


def _long(word: str, suffix: str) -> bool:
    """Suffixes count only with more than two bytes before them."""
    return word.endswith(suffix) and len(word.encode()) > len(suffix.encode()) + 2


def cvv(t: str) -> Iterator[tuple[int, int]]:
    """Three digits, apart or not, that a signature within 160 characters claims and nothing competing does."""
    signs = None
    for m in _DIGIT_RUN.finditer(t):
        digits = [i for i in range(m.start(), m.end()) if t[i].isdigit()]
        s, e = digits[0], digits[-1] + 1
        if len(digits) != 3 or (s and t[s - 1].isalnum()) or (e < len(t) and t[e].isalnum()):
            continue
        if signs is None:
            signs = [(x.start(1), x.end(1)) for x in _CVV_SIGN.finditer(t)]
        after, before = _STRONG.search(t, e, e + 20), [x.end() for x in _STRONG.finditer(t, max(0, s - 20), s)]
        # what competes next to the value counts only up to a strong separator that is there
        near = (t[e : after.start()] if after else "") + "\n" + (t[before[-1] : s] if before else "")
        if _COMPETING.search(near):
            continue
        for a, z in signs:
            gap = t[z:s] if s - 160 <= a and z <= s else t[e:a] if e <= a and z <= e + 160 else None
            if gap is not None and ";" not in gap and sum(map(gap.count, ".!?…")) <= 1 and not _COMPETING.search(gap) and not any(c.isdigit() for c in gap):
                yield s, e
                break


@lru_cache(maxsize=16)
def _heads(known: frozenset[str]) -> frozenset[str]:
    """What stands before the last words of ``known``, with the space after it."""
    return frozenset(x[: x.rfind(" ") + 1] for x in known)


@lru_cache(maxsize=16)
def _firsts(known: frozenset[str]) -> frozenset[str]:
    """The first words of ``known`` that have more than one."""
    return frozenset(x.split()[0] for x in known if len(x.split()) > 1)


@lru_cache(maxsize=1 << 16)
def country(phrase: str, known: frozenset[str]) -> bool:
    """A country's name, also in another case: endings are replaced or cut from the last word."""
    if phrase in known:
        return True
    words = phrase.split()
    if not words:
        return False
    head, last = " ".join(words[:-1]) + " " * (len(words) > 1), words[-1]
    if head not in _heads(known):
        return False
    stems = [last[: -len(a)] + b for a, b in COUNTRY_ENDS if _long(last, a)]
    for end in COUNTRY_CASES:
        if _long(last, end):
            stems += [last[: -len(end)] + x for x in ("", "а", "я")]
    return any(head + x in known for x in stems)


def citizenship(t: str, known: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Phrases of three words down to one, each word used once.  A span starts at its first word as written, with its punctuation."""
    words = [(m.group(), m.start()) for m in re.finditer(r"\S+", t)]
    bare, firsts = [w.strip(_PUNCTUATION) for w, _ in words], _firsts(known)
    i = 0
    while i < len(words):
        for n in (3, 2, 1):
            # of several words, none of them punctuation alone, the first is the first of a country's
            if n > 1 and words[i][0].lstrip(_PUNCTUATION) not in firsts and all(bare[i : i + n]):
                continue
            phrase = bare[i] if n == 1 else " ".join(w for w, _ in words[i : i + n]).strip(_PUNCTUATION)
            if i + n <= len(words) and country(phrase, known):
                yield words[i][1], words[i][1] + len(phrase)
                i += n - 1
                break
        i += 1


def birth_place(t: str) -> Iterator[tuple[int, int]]:
    """The words after a birth keyword, to the first field name of the list that occurs."""
    for m in _PLACE.finditer(t) if any(x in t for x in _PLACE_KEYS) else ():
        raw = m.group(1)
        place = raw.strip()
        end = next((x for x in PLACE_ENDS if x in place), None)
        place = (place[: place.index(end)] if end else place).strip()
        start = m.start(1)
        if place == "в":
            continue
        if place.startswith("в "):
            rest = place[2:].strip()
            start, place = start + (place.index(rest) if rest else 2), rest
        if place:
            yield start, start + len(place)


def name_weight(word: str, first: frozenset[str], last: frozenset[str]) -> float:
    """How much a word looks like a part of a name; 0: not at all."""
    if word in first:
        return 0.4
    if word in last:
        return 0.35
    if not word.endswith(PATRONYMIC + SURNAME):
        return 0.0
    if any(_long(word, x) for x in PATRONYMIC):
        return 0.3
    return 0.2 if any(_long(word, x) for x in SURNAME) else 0.0


def full_name(t: str, first: frozenset[str], last: frozenset[str], known: frozenset[str]) -> Iterator[tuple[int, int, float]]:
    """Runs of two or three words like names, whatever stands between them."""
    run: list[tuple[str, int, int, float]] = []

    def ended() -> Iterator[tuple[int, int, float]]:
        if len(run) >= 2:
            score = 0.0
            for *_, w in run:
                score += w
            if len(run) == 3 and any(_long(run[1][0], x) for x in PATRONYMIC):
                score += 0.2
            score = min(score, 1.0)
            if t[run[0][1] : run[-1][2]] in known:
                score = max(0.0, score - 0.15)
            yield run[0][1], run[-1][2], score
        run.clear()

    for m in _NAME_WORD.finditer(t):
        w = name_weight(m.group(), first, last)
        if w:
            run.append((m.group(), m.start(), m.end(), w))
        if not w or len(run) == 3:
            yield from ended()
    yield from ended()


def address(t: str, structure: frozenset[str]) -> Iterator[tuple[int, int]]:
    """What follows a signature, up to 120 characters, a semicolon or the next field; it must name a street, house or the like."""
    for m in _ADDRESS_SIGN.finditer(t) if any(x in t for x in ADDRESS_SIGNATURES) else ():
        s = m.end(1)
        while s < len(t) and (t[s] == ":" or t[s].isspace()):
            s += 1
        e = min(len(t), s + 120)
        if (x := t.find(";", s, e)) >= 0:
            e = x
        if (x := next((y.start() for y in _ADDRESS_STOP.finditer(t, s, min(len(t), e + 40)) if y.start() < e), None)) is not None:
            e = x
        while e > s and (t[e - 1].isspace() or t[e - 1] in ",;:"):
            e -= 1
        words = t[s:e].split()
        if any(w in structure for w in words) or any(re.fullmatch("[0-9]{6}", w) for w in words):
            yield s, e


def walking(first=W.FIRST_NAMES, last=W.LAST_NAMES, known=W.KNOWN_PERSON_NAMES, countries=W.COUNTRIES, structure=W.ADDRESS_STRUCTURE_KEYWORDS):
    """A function from a normalized text to ``(type, s, e, score, sources, reg)`` of the five types; the word lists are parameters."""
    a, b, c, d, f = (frozenset(x.lower() for x in xs) for xs in (first, last, known, countries, structure))

    def one(t: str) -> list[tuple]:
        out: list[tuple] = [("CVV", s, e, 0.7, ("regex", "context"), 4) for s, e in cvv(t)]
        out += [("CITIZENSHIP", s, e, 0.3, ("dictionary",), 12) for s, e in citizenship(t, d)]
        out += [("BIRTH_PLACE", s, e, 0.7, ("regex", "context"), 13) for s, e in birth_place(t)]
        out += [("FULL_NAME", s, e, w, ("regex", "dictionary"), 14) for s, e, w in full_name(t, a, b, c)]
        out += [("ADDRESS", s, e, 0.6, ("regex", "context"), 15) for s, e in address(t, f)]
        return out

    return one


def recognizer(**lists):
    """A column function from normalized text to the spans of the five types; the word lists are parameters, as of :func:`walking`."""
    rules = walking(**lists)

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        guard = re.compile(GUARD)

        def one(t):
            if t is None or not guard.search(t):
                return []
            return [dict(zip(("type", "s", "e", "score", "sources", "reg"), x)) for x in rules(t)]

        return texts.map(one)

    return find
