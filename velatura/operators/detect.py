"""The rule net: patterns and checksums that find personal data in texts, as one narrow projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velatura.functions import checksums, plain
from velatura.functions.classes import unicode
from velatura.functions.spans import SPAN, exploded, find, span


@dataclass(frozen=True)
class Detector:
    """A label's pattern, written with \\w \\d \\s \\b. strict: a match that fails the check is dropped; otherwise the check only sets `validated`.

    check and plain: the check as a Column and of one value. gate: the name in GATES of a cheap test of the whole text without which the
    pattern can't match. trim: characters that a match may not end in. fold: upper and lower case are the same.
    """

    name: str
    label: str
    source: str
    check: Callable[[Column], Column] | None = None
    plain: Callable[[str], bool] | None = None
    strict: bool = True
    gate: str = "any"
    trim: str = ""
    fold: bool = False

    @property
    def pattern(self) -> str:
        """The pattern for the JVM, whose own classes are narrower."""
        return ("(?iu)" if self.fold else "") + unicode(self.source)


#: Tests of whole texts, each made once for all detectors that name it.
GATES: dict[str, Callable[[Column], Column]] = {
    "any": lambda t: t.isNotNull(), "digit": lambda t: t.rlike(r"\p{Nd}"), "at": lambda t: F.contains(t, F.lit("@")), "dot": lambda t: t.rlike(r"://|[A-Za-z0-9]\.[A-Za-z0-9]"),
}
#: The patterns of the rule net.
DETECTORS = (
    Detector("email", "EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", gate="at"),
    Detector("cf", "CF", r"\b[A-Za-z]{6}\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}[A-Za-z]\b", checksums.tax_code_ok, plain.tax_code_ok, strict=False, gate="digit"),
    Detector(
        "cf_omocodic", "CF",
        r"\b[A-Za-z]{6}[\dLMNPQRSTUVlmnpqrstuv]{2}[A-Za-z][\dLMNPQRSTUVlmnpqrstuv]{2}[A-Za-z][\dLMNPQRSTUVlmnpqrstuv]{3}[A-Za-z]\b", checksums.tax_code_ok, plain.tax_code_ok,
    ),
    Detector("iban", "IBAN", r"\b[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}\b", checksums.iban_ok, plain.iban_ok, gate="digit"),
    Detector("card", "CREDITCARDNUMBER", r"(?<!\d)\d(?:[ .\-]?\d){12,18}(?!\d)", checksums.luhn_ok, plain.luhn_ok, gate="digit"),
    Detector("piva", "PIVA", r"(?<!\d)\d{11}(?!\d)", checksums.vat_ok, plain.vat_ok, gate="digit"),
    Detector("phone", "TELEPHONENUM", r"(?<![\w.])(?:\+39[\s.\-]?)?(?:3\d{2}[\s.\-]?\d{3}[\s.\-]?\d{3,4}|0\d{1,3}[\s.\-]?\d{5,8})(?![\w])", gate="digit"),
    Detector("amount", "AMOUNT", r"(?:€|EUR|euro)\s?\d{1,3}(?:[.\s]\d{3})*(?:,\d{2})?|\d{1,3}(?:\.\d{3})*,\d{2}\s?(?:€|EUR|euro)", gate="digit", fold=True),
    Detector("plate", "TARGA", r"\b[A-Za-z]{2}[\s-]?\d{3}[\s-]?[A-Za-z]{2}\b", gate="digit"),
    Detector(
        "url", "URL",
        r"(?:https?|ftp)://[^\s<>\"']+|www\.[A-Za-z0-9\-._~%]+\.[A-Za-z]{2,}(?:/[^\s<>\"']*)?"
        r"|\b(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+(?:it|com|net|org|eu|info|io|dev|app|gov|edu|cloud|online|site|blog)\b(?:/[^\s<>\"']*)?",
        gate="dot", trim=".,;:!?)]}»\"'", fold=True,
    ),
    Detector(
        "docid", "DOCID",
        r"\b(?:R\.?G\.?\s*N\.?R\.?|R\.?G\.?|RG|Prot\.?|protocollo|Rep\.?|repertorio)(?:\s*(?:n\.?|num\.?|nro\.?))?\s*\d{1,8}(?:[/\-]\d{2,4})?\b", gate="digit", fold=True,
    ),
    Detector("date", "DATE", r"(?<!\d)(?:0?[1-9]|[12]\d|3[01])[/.\-](?:0?[1-9]|1[0-2])[/.\-](?:19|20)\d{2}(?:\s+\d{1,2}[:.]\d{2})?(?!\d)", gate="digit"),
)
#: Labels whose shape alone is no evidence: their spans yield to those of a recogniser.
SOFT_LABELS = ("DATE",)
BY_NAME = {d.name: d for d in DETECTORS}
#: Places in the order of candidates: a recogniser's come first, then printed bank account numbers, then the patterns by turns.
STRIDE = 1_000_000


def candidates(text: Column, detector: Detector, turn: int = 1, gate: Column | None = None) -> Column:
    """array<span> of one detector over a text; a null text has none."""
    hits = find(text, detector.pattern)
    if detector.trim:
        own = "".join("\\" + c for c in detector.trim)
        cut = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.regexp_replace(h["value"], f"[{own}]+$", "").alias("value")))
        hits = F.filter(F.transform(cut, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.length(h["value"])).alias("end"), h["value"].alias("value"))), lambda h: h["end"] > h["start"])
    # The check's outcome is a field of its own before it is used twice.
    checked = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), (detector.check(h["value"]) if detector.check else F.lit(False)).alias("ok")))
    spans = F.transform(checked, lambda h, i: span(F.lit(detector.label), h["start"], h["end"], F.when(h["ok"], 1.0).otherwise(0.9), h["ok"], F.lit("regex"), F.lit(turn * STRIDE) + i))
    if detector.check and detector.strict:
        spans = F.filter(spans, lambda s: s["validated"])
    gate = GATES[detector.gate](text) if gate is None else gate
    return F.when(text.isNotNull() & gate, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def detect(docs: DataFrame, text_col: str = "text", detectors: tuple[Detector, ...] = DETECTORS, out: str = "candidates", grouped_iban: bool = True) -> DataFrame:
    """The rows with an array of all candidates. Patterns are evaluated in the JVM; printed account numbers by an Arrow function,
    over the few texts that can hold one."""
    text = F.col(text_col)
    names = [f"__{out}_{d.name}" for d in detectors]
    gates = {g: f"__{out}_gate_{g}" for g in sorted({d.gate for d in detectors})}
    gated = docs.select("*", *[GATES[g](text).alias(n) for g, n in gates.items()])
    found = gated.select("*", *[candidates(text, d, i + 2, F.col(gates[d.gate])).alias(n) for i, (d, n) in enumerate(zip(detectors, names))])
    parts = [F.col(n) for n in names]
    if grouped_iban:
        from velatura.operators.iban import grouped_iban_spans

        head = F.when(text.rlike(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}"), text)
        found = found.withColumn(f"__{out}_grouped", grouped_iban_spans(head))
        parts.insert(0, F.col(f"__{out}_grouped"))
    return found.withColumn(out, F.concat(*parts)).drop(*names, *gates.values(), f"__{out}_grouped")


def detect_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detectors: tuple[Detector, ...] = DETECTORS, grouped_iban: bool = True, engine: str = "native") -> DataFrame:
    """One row for each candidate: id, label, start, end, score, validated, source, ord, value. engine: "native" for the JVM's expressions, which suit
    one detector behind a gate that few texts pass; "arrow" for the whole rule net, and for texts that most detectors find something in."""
    if engine == "arrow":
        from velatura.operators.rows import hits_column

        return exploded(docs, [id_col], hits_column(F.col(text_col), detectors, grouped_iban), "c").select(id_col, "c.*")
    found = detect(docs.select(id_col, text_col), text_col, detectors, grouped_iban=grouped_iban)
    return exploded(found, [id_col, text_col], F.col("candidates"), "c").select(id_col, "c.*", F.substring(F.col(text_col), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("value"))
