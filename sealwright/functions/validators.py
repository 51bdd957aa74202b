"""Checks of a rule's match, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """12 to 19 digits (others are ignored) whose Luhn sum is 0."""
    d = _digits(x)
    return F.coalesce(F.length(d).between(12, 19) & F.call_function("luhn_check", d), F.lit(False))


def _sum_weighted(d: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.coalesce(F.substring(d, i + 1, 1).try_cast("int"), F.lit(0)) * w
    return total


def pesel(x: Column) -> Column:
    """Eleven digits with a month code, a day of 1 to 31 and the check digit."""
    d = _digits(x)
    month, day = F.substring(d, 3, 2).try_cast("int"), F.substring(d, 5, 2).try_cast("int")
    check = (10 - _sum_weighted(d, [1, 3, 7, 9] * 2 + [1, 3]) % 10) % 10
    good = (F.length(d) == 11) & ((month % 20).between(1, 12)) & (month < 100) & day.between(1, 31) & (check == F.substring(d, 11, 1).try_cast("int"))
    return F.coalesce(good, F.lit(False))


def iban(x: Column) -> Column:
    """15 to 34 letters and digits (white space ignored), rotated by four, 1 modulo 97."""
    s = F.regexp_replace(x, r"(?U)\s", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    value = lambda c: F.coalesce(c.try_cast("int"), F.ascii(F.upper(c)) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))
    return F.coalesce(F.when(F.octet_length(s).between(15, 34) & s.rlike("^[0-9A-Za-z]+$"), rest == 1), F.lit(False))


VALIDATORS: dict[str, Callable[[Column], Column]] = {"luhn": luhn, "pesel": pesel, "iban": iban}
