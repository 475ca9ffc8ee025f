"""The checks of functions.checksums for single values, used inside Arrow functions."""

from __future__ import annotations

import re

from velatura.functions.checksums import ODD

_SEPARATORS = re.compile(r"[\s.\-]")


def digits_of(value: str) -> str:
    """Decimal digits of a value; none at all if some are not ASCII."""
    found = "".join(c for c in value if c.isdecimal())
    return found if found.isascii() else ""


def _second_doubled(digits: str, first: int) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 == first else int(c) for i, c in enumerate(digits))


def luhn_ok(value: str) -> bool:
    d = digits_of(value)
    return 13 <= len(d) <= 19 and _second_doubled(d[::-1], 1) % 10 == 0


def vat_digit(ten: str) -> int:
    return -_second_doubled(ten, 1) % 10


def vat_ok(value: str) -> bool:
    d = digits_of(value)
    return len(d) == 11 and vat_digit(d[:10]) == int(d[10])


def check_letter(body: str) -> str:
    """The check character of upper-case letters and digits."""
    return chr(65 + sum(ODD[c] if i % 2 == 0 else int(c, 36) - 10 * c.isalpha() for i, c in enumerate(body)) % 26)


def tax_code_ok(value: str) -> bool:
    s = value.strip(" ").upper()
    return len(s) == 16 and s.isascii() and s.isalnum() and check_letter(s[:15]) == s[15]


def remainder(code: str) -> int:
    """Of an account number, modulo 97, with the first four characters at the end."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def iban_ok(value: str) -> bool:
    s = _SEPARATORS.sub("", value).upper()
    return 15 <= len(s) <= 34 and s.isascii() and s.isalnum() and remainder(s) == 1
