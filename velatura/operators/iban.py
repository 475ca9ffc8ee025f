"""Bank account numbers as printed, in groups: the registered length of the country says where one ends."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from velatura.functions.plain import remainder
from velatura.functions.spans import SPAN

#: Length of an account number by country, as registered under ISO 13616.
LENGTHS = dict(re.findall(r"([A-Z]{2})(\d{2})", """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18
FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27
MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27
SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"""))  # fmt: skip
#: Most separators in a row, longest group after which one may stand, and what a number begins with.
MAX_SEPARATORS, MAX_GROUP = 3, 5
_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}")
_SEPARATOR = re.compile(r"[\s\x1c-\x1f\x85.\-]+")
_CODE = re.compile(r"[A-Za-z0-9]+")


def _grouped(text: str, start: int, length: int) -> int | None:
    """End of a number of `length` characters that starts here in groups, or None."""
    groups: list[str] = []
    at, count, breaks = start, 0, 0
    while True:
        m = _CODE.match(text, at)
        if m is None:
            return None
        group = m[0]
        if count + len(group) > length:
            return None  # the code goes on
        groups.append(group)
        count, at = count + len(group), m.end()
        if count == length:
            break
        gap = _SEPARATOR.match(text, at)
        if gap is None or len(gap[0]) > MAX_SEPARATORS or len(group) > MAX_GROUP:
            return None
        breaks += sum(c.isspace() and c not in " \t\xa0" for c in gap[0])
        if breaks > 1:
            return None
        at = gap.end()
    if len(groups) > 1 and (len({len(g) for g in groups[:-1]}) > 1 or len(groups[-1]) > len(groups[0])):
        return None
    code = "".join(groups).upper()
    return at if 15 <= len(code) <= 34 and remainder(code) == 1 else None


def find_grouped(text: str) -> list[tuple[int, int]]:
    """(start, end) of printed account numbers; those that overlap are joined, for either may be the true one."""
    found: list[tuple[int, int]] = []
    for m in _HEAD.finditer(text):
        start = m.start()
        length = LENGTHS.get(m[0][:2].upper())
        if length is None or not m[0].isascii() or start and text[start - 1].isalnum():
            continue
        end = _grouped(text, start, int(length))
        if end is None:
            continue
        if found and start < found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def grouped_iban_spans(text: Column) -> Column:
    """array<span> of each text; null texts have none."""

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"label": "IBAN", "start": a, "end": b, "score": 1.0, "validated": True, "source": "regex", "ord": 1_000_000 + i} for i, (a, b) in enumerate(find_grouped(t) if t else ())])

    return spans(text)
