"""Check digits of Italian and international identifiers as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velatura.functions.classes import DIGIT, SPACE

#: What a character counts at the odd places of a tax code and of a bank check character.
ODD = {
    "0": 1, "1": 0, "2": 5, "3": 7, "4": 9, "5": 13, "6": 15, "7": 17, "8": 19, "9": 21,
    "A": 1, "B": 0, "C": 5, "D": 7, "E": 9, "F": 13, "G": 15, "H": 17, "I": 19, "J": 21,
    "K": 2, "L": 4, "M": 18, "N": 20, "O": 11, "P": 3, "Q": 6, "R": 8, "S": 12, "T": 14,
    "U": 16, "V": 10, "W": 22, "X": 25, "Y": 24, "Z": 23,
}
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def chars(c: Column) -> Column:
    return F.split(c, "")


def value36(c: Column) -> Column:
    """0 to 9 and A to Z as 0 to 35; other characters as -1."""
    return F.instr(F.lit(ALPHABET), c) - 1


def odd_value(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ODD[a]) for a in ALPHABET]), F.instr(F.lit(ALPHABET), c))


def even_value(c: Column) -> Column:
    """A digit counts as itself and a letter by its place in the alphabet."""
    return F.when(value36(c) < 10, value36(c)).otherwise(value36(c) - 10)


def decimal_digits(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{DIGIT}]", "")


def mod97(c: Column) -> Column:
    """Remainder of the number that results when letters are written as 10 to 35."""
    return F.aggregate(chars(c), F.lit(0), lambda r, x: (r * F.when(value36(x) > 9, 100).otherwise(10) + value36(x)) % 97)


def iban_ok(c: Column) -> Column:
    """Bank account number: 15 to 34 characters without separators, remainder 1 once the first four are at the end."""
    s = F.upper(F.regexp_replace(c, rf"[{SPACE}.\-]", ""))
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    return _false_if_null(F.when(s.rlike("^[0-9A-Z]{15,34}$"), mod97(turned) == 1).otherwise(False))


def _doubled_sum(digits: Column, first: int) -> Column:
    """Digit sum with every second digit doubled (less 9 above 9), from the index `first` on."""
    weighted = F.transform(chars(digits), lambda x, i: F.when(i % 2 == first, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x)


def vat_check_digit(ten: Column) -> Column:
    return (10 - _doubled_sum(ten, 1) % 10) % 10


def vat_ok(c: Column) -> Column:
    """Italian VAT number: eleven digits (others are passed over), the last of which is the check digit."""
    d = decimal_digits(c)
    return _false_if_null(F.when(d.rlike("^[0-9]{11}$"), vat_check_digit(F.substring(d, 1, 10)) == F.substring(d, 11, 1).cast("int")).otherwise(False))


def vat_ok_strict(c: Column) -> Column:
    """As vat_ok, for a value that must be eleven digits as it stands."""
    return _false_if_null(c.rlike("^[0-9]{11}$")) & vat_ok(c)


def check_character(body: Column) -> Column:
    """Letter of the sum over odd and even places, modulo 26."""
    total = F.aggregate(F.transform(chars(body), lambda x, i: F.when(i % 2 == 0, odd_value(x)).otherwise(even_value(x))), F.lit(0), lambda a, x: a + x)
    return F.char(F.lit(65) + total % 26)


def tax_code_ok(c: Column) -> Column:
    """Italian tax code: sixteen letters and digits, the last of which is the check character."""
    s = F.upper(F.trim(c))
    return _false_if_null(F.when(s.rlike("^[0-9A-Z]{16}$"), check_character(F.substring(s, 1, 15)) == F.substring(s, 16, 1)).otherwise(False))


def luhn_ok(c: Column) -> Column:
    """Payment card: 13 to 19 digits (others are passed over) that pass Luhn's check."""
    d = decimal_digits(c)
    return _false_if_null(F.when(d.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", d)).otherwise(False))


def iban_ok_strict(c: Column) -> Column:
    """As iban_ok, for a value without separators."""
    return _false_if_null(c.rlike("^[A-Za-z0-9]{15,34}$")) & iban_ok(c)
