"""Patterns of the rules, written once in the dialect of RE2 and translated for Spark."""

from __future__ import annotations

# Patterns that decide results.  ``\b`` is ASCII there, and ``\s`` matches ASCII white space.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+7|8|7)[\s\-]?(?:\(\d{3}\)|\d{3})[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
INN = r"\b\d{10}\b|\b\d{12}\b"
CARD_NUMBER = r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"
PIN = r"\b\d{4}\b"
CARDHOLDER_NAME = r"(?i)\b[a-z][a-z\s]{2,40}\b"
PASSPORT = r"\b\d{2}\s?\d{2}\s?№?\s?\d{6}\b"
PASSPORT_SPLIT = r"серия\s+\d{2}\s?\d{2}\s*,?\s*номер\s+\d{6}|серия\s+\d{4}\s*,?\s*номер\s+\d{6}"
DEPARTMENT_CODE = r"\b\d{3}[-–]\d{3}\b"
DRIVER_LICENSE = r"\b(?:\d{4}\s?\d{6}|\d{2}\s?[-–]?\s?\d{2}\s?№?\s?\d{6})\b"
PASSPORT_ISSUER = r"(?:выдан|выдано|орган, выдавший|кем выдан)[:\s]+([а-яёa-z\s.\-]{5,80}?)(?:,|\s+\d|$)"
DATE_NUMERIC = r"\b\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b"
DATE_ISO = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_WORDS = r"\b\d{1,2}\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)\s+\d{4}\b"
YEAR = r"\b(?:19\d{2}|20\d{2})\b"
BIRTH_PLACE = r"(?:место рождения|родился|родилась|уроженец|уроженка|родом из)[:\s]+(?:в\s+\d{4}\s+году\s+)?([а-яёa-z\s.,\-]{2,60})"
TOKEN = r"<[A-Z_]+_[0-9]+>"
# Gate signals on text that is left.
GATE = {
    "passport_like_digits": r"\b\d{2}\s?\d{2}\s?№?\s?\d{6}\b|\b\d{4}\s?\d{6}\b",
    "identifier_digits": r"\b\d{10}\b|\b\d{12}\b",
    "card_like_digits": r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b",
    "phone_like": r"(?:\+7|8|7)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}",
    "email_like": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "date_like": r"\b\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b",
    "department_code_like": r"\b\d{3}[-–]\d{3}\b",
    "security_code_like": r"\b\d{3}\b|\b\d{4}\b",
    "name_like": r"[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){1,2}",
}
# White space of Unicode, and the characters that count as a hyphen.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d\u00ad"
DELIMITERS = ".,;:!?\u2026\u2013\u2014()[]{}\"'\u00ab\u00bb-"

_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def to_java(pattern: str) -> str:
    """``pattern`` for Spark: an ASCII word edge, the same white space, and an end that is the end of the text."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out.append(_EDGE)
            i += 2
        elif two == r"\s":
            out.append(r"\t\n\f\r " if inside else r"[\t\n\f\r ]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out.append(r"\z" if pattern[i] == "$" and not inside else pattern[i])
            i += 1
    return "".join(out)


def least_words(words) -> tuple[str, ...]:
    """``words`` in lower case without those that contain a shorter one, as it occurs where they do."""
    kept: list[str] = []
    for w in sorted({w.lower() for w in words}, key=lambda w: (len(w), w)):
        if not any(k in w for k in kept):
            kept.append(w)
    return tuple(sorted(kept))


def any_of(words) -> str:
    """A pattern for any of ``words``, literally; words that contain a shorter one are left out, as it matches where they do."""
    return "|".join("".join("\\" + c if c in r"\.+*?()|[]{}^$" else c for c in w) for w in least_words(words)) or "(?!)"
