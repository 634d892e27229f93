"""Checksums and calendar tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of control digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_A = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_B = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def _digit(v: Column, i: int) -> Column:
    return F.try_to_number(F.substr(v, F.lit(i + 1), F.lit(1)), F.lit("9")).cast("int")


def _control(v: Column, weights: tuple[int, ...]) -> Column:
    total = reduce(lambda a, b: a + b, [_digit(v, i) * w for i, w in enumerate(weights)])
    return total % 11 % 10


def all_same(v: Column) -> Column:
    return v.rlike(r"^(.)\1*$")


def valid_inn(v: Column) -> Column:
    """Control digits of 10- or 12-digit tax numbers; all digits alike never pass."""
    ten = (F.length(v) == 10) & (_control(v, INN10) == _digit(v, 9))
    twelve = (F.length(v) == 12) & (_control(v, INN12_A) == _digit(v, 10)) & (_control(v, INN12_B) == _digit(v, 11))
    return F.coalesce(v.rlike("^[0-9]+$") & ~all_same(v) & (ten | twelve), F.lit(False))


def valid_card(v: Column) -> Column:
    """16 digits that pass the Luhn check and are not all alike; spaces and hyphens do not count."""
    d = F.regexp_replace(v, r"[\s\-]", "")
    return F.coalesce((F.length(d) == 16) & F.call_function("luhn_check", d) & ~all_same(d), F.lit(False))


def _calendar(year: Column, month: Column, day: Column) -> Column:
    made = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(made.isNotNull() & year.cast("int").between(1900, 2100) & (F.length(year) == 4), F.lit(False))


def valid_dmy(v: Column) -> Column:
    """Day, month, year with ``.``, ``/`` or ``-``; years from 1900 to 2100."""
    p = F.split(v, r"[./\-]")
    return _calendar(F.get(p, F.lit(2)), F.get(p, F.lit(1)), F.get(p, F.lit(0)))


def valid_iso(v: Column) -> Column:
    p = F.split(v, "-")
    return _calendar(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)))
