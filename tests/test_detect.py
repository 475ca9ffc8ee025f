import random
import re

import pytest
from pyspark.sql import functions as F

from velatura.functions import checksums, plain
from velatura.functions.spans import find
from velatura.operators import rows as R
from velatura.operators.detect import detect_rows
from velatura.operators.generate import BUILT_IN, Draws
from velatura.operators.iban import LENGTHS, find_grouped

WHOLE = [
    ("EMAIL", "m.bianchi+studio@sub.example.it"), ("CF", "RSSMRA85H12F205Y"), ("CF", "BNCMRA68C12L750C"), ("IBAN", "IT60X0542811101000000123456"), ("IBAN", "ES9121000418450200051332"),
    ("IBAN", "IT60 X054 2811 1010 0000 0123 456"), ("IBAN", "IT60-X054-2811-1010-0000-0123-456"), ("CREDITCARDNUMBER", "4111 1111 1111 1111"), ("CREDITCARDNUMBER", "4111.1111.1111.1111"), ("PIVA", "00743110157"), ("PIVA", "02114800036"),
    ("TELEPHONENUM", "+39 333 1234567"), ("TELEPHONENUM", "333-123-4567"), ("TELEPHONENUM", "010-2471234"), ("AMOUNT", "€ 12.500,00"), ("AMOUNT", "1.250,00 EUR"), ("TARGA", "AB 123 CD"), ("TARGA", "AB-123-CD"),
    ("URL", "https://www.example.it/a?b=c"), ("URL", "www.example.org/x"), ("URL", "studio.example.it"), ("DOCID", "R.G. 1234/2024"), ("DOCID", "Prot. n. 456/2024"), ("DOCID", "repertorio 45"), ("DATE", "12/06/1985"), ("DATE", "1.2.2020 10:30"),
]
NOTHING = ["12345678901", "4111 1111 1111 1112", "IT60X0542811101000000123457", "IT60 X054 2811 1010 0000 0123 45", "p.iva e n.ro", "32/13/2020", "art. 1234/2024", "RSSMRA85HMNF205Z", "il 17 luglio 2008 a Roma"]


@pytest.fixture(scope="module")
def hits(spark):
    texts = [(i, f"Si indica {v}, come detto.") for i, (_, v) in enumerate(WHOLE)] + [(100 + i, f"Nota: {v}.") for i, v in enumerate(NOTHING)] + [(500, None), (501, ""), (502, "CF RSSMRA85M01H501Z; x")]
    return detect_rows(spark.createDataFrame(texts, "doc_id long, text string")).collect()


@pytest.mark.parametrize("i", range(len(WHOLE)))
def test_found_whole(hits, i):
    label, value = WHOLE[i]
    assert (label, value) in {(h.label, h.value) for h in hits if h.doc_id == i}
    assert all(h.end - h.start == len(h.value) for h in hits)


@pytest.mark.parametrize("i", range(len(NOTHING)))
def test_not_found(hits, i):
    checked = {"CF", "PIVA", "IBAN", "CREDITCARDNUMBER", "URL", "DOCID", "DATE"}
    assert not [h for h in hits if h.doc_id == 100 + i and h.label in checked]


def test_wrong_tax_code_stays_but_unvalidated(hits):
    assert [(h.label, h.validated) for h in hits if h.doc_id == 502] == [("CF", False)]
    assert not [h for h in hits if h.doc_id in (500, 501)]


def test_places_equal_finditer(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", "1", " ", "é", "😀", "\n", "\x01", "x1"], k=rng.randrange(400))) for _ in range(60)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", find(F.col("t"), "[a1]+").alias("m")).collect()
    for r in got:
        assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a1]+", texts[r.i])]


def test_checks_equal_plain_python(spark):
    rows = []
    for i in range(200):
        d = Draws(1, i)
        rows.append(tuple(BUILT_IN[k](d) for k in ("tax code", "vat number", "account number")))
    wrong = [("RSSMRA85H12F205Z", "12345678901", "IT60X0542811101000000123457"), (None, None, None), ("", "", ""), ("ééé", "123", "IT")]
    df = spark.createDataFrame(rows + wrong, "cf string, piva string, iban string").select(checksums.tax_code_ok(F.col("cf")).alias("a"), checksums.vat_ok(F.col("piva")).alias("b"), checksums.iban_ok(F.col("iban")).alias("c"), checksums.vat_ok_strict(F.col("piva")).alias("d"))
    got = df.collect()
    assert all(all(r) for r in got[:200]) and not any(any(r) for r in got[200:])
    assert [(plain.tax_code_ok(a), plain.vat_ok(b), plain.iban_ok(c)) for a, b, c in rows + wrong if a is not None] == [(r.a, r.b, r.c) for r, x in zip(got, rows + wrong) if x[0] is not None]


PIECES = [v for _, v in WHOLE] + NOTHING + ["RSSMRA85M01H501Z", "a", "x1", " ", "  ", "\n", ".", "-", "/", "é", "٣", "12", "€", "R.G.", "IT60", "www.", "@", "(", "0612345678", "+39"]


def test_both_engines_find_the_same(spark):
    """The expressions of the JVM and the plain functions, on texts where values touch and break off."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for h in detect_rows(df).collect():
        got.setdefault(h.doc_id, set()).add((h.label, h.start, h.end, h.score, h.validated, h.source, h.ord))
    for i, t in enumerate(texts):
        assert got.get(i, set()) == set(R.detect(t)), t


def test_luhn(spark):
    got = spark.createDataFrame([("4111 1111 1111 1111",), ("4111111111111112",), ("0",), ("0000000000000",), (None,)], "c string").select(checksums.luhn_ok(F.col("c"))).collect()
    assert [r[0] for r in got] == [True, False, False, True, False]


def test_printed_account_numbers():
    good = "IT60 X054 2811 1010 0000 0123 456"
    assert len(LENGTHS) == 89
    assert find_grouped(f"conto {good} della parte") == [(6, 6 + len(good))]
    assert find_grouped("IT60\nX054 2811 1010 0000 0123 456") and not find_grouped("IT60\nX054\n2811 1010 0000 0123 456")
    assert not find_grouped("IT60 X054 2811 1010 0000 0123 4567") and not find_grouped("IT60 X05 42811 1010 0000 0123 456") and not find_grouped(f"z{good}")
