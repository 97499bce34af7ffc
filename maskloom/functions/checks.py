"""Checksums of national and payment identifiers, and makers of valid test values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(digits: Column, k: int) -> Column:
    return F.substring(digits, k + 1, 1).try_cast("int")


def tckn_valid(value: Column) -> Column:
    """Turkish identity number: 11 digits, the first not 0, tenth and eleventh are checks."""
    d = [_digit(value, k) for k in range(11)]
    tenth = F.pmod(7 * (d[0] + d[2] + d[4] + d[6] + d[8]) - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
    eleventh = sum(d[1:10], d[0]) % 10
    return F.coalesce(value.rlike("^[1-9][0-9]{10}$") & (d[9] == tenth) & (d[10] == eleventh), F.lit(False))


def tckn_complete(nine: Column) -> Column:
    """The 11-digit number whose first nine digits are ``nine``."""
    d = [_digit(nine, k) for k in range(9)]
    tenth = F.pmod(7 * (d[0] + d[2] + d[4] + d[6] + d[8]) - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
    eleventh = (sum(d[1:9], d[0]) + tenth) % 10
    return F.concat(nine, tenth.cast("string"), eleventh.cast("string"))


def mod97(text: Column) -> Column:
    """Remainder by 97 of digits and letters (A = 10 ... Z = 35), read left to right."""
    chars = F.filter(F.split(F.upper(text), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + value(c)) % 97).otherwise((r * 100 + value(c)) % 97))


def iban_valid(value: Column) -> Column:
    """Two letters, two check digits, 11 to 30 more characters; ISO 13616 remainder 1."""
    plain = F.upper(F.regexp_replace(value, "[ -]", ""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    return F.coalesce(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (mod97(moved) == 1), F.lit(False))


def iban_complete(country: Column, account: Column) -> Column:
    """The IBAN of an account part: check digits are 98 less the remainder with 00 in their place."""
    rest = 98 - mod97(F.concat(account, country, F.lit("00")))
    return F.concat(country, F.lpad(rest.cast("string"), 2, "0"), account)


def card_valid(value: Column) -> Column:
    """13 to 19 digits, spaces and dashes aside, that pass the Luhn check."""
    plain = F.regexp_replace(value, "[ -]", "")
    return F.coalesce(plain.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", plain), F.lit(False))


def luhn_complete(digits: Column) -> Column:
    """``digits`` with a Luhn check digit after them."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    part = F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.when(c.try_cast("int") * 2 > 9, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)).otherwise(c.try_cast("int")))
    total = F.aggregate(part, F.lit(0), lambda a, x: a + x)
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))
