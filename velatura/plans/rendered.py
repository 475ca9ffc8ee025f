"""Documents with known identifiers, derived from orders and customers by arithmetic alone, in Spark and in SQL.

Some classes of keys get a wrong check digit, so that checks have something to turn away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.functions import checksums
from velatura.operators.rows import per_row

LETTERS = "BCDFGHJKLM"


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


#: Rows of a task: what is made of a row costs far more than to deal it out, and a task's time doesn't grow with the table.
TASK_ROWS = 25_000


def _codes(texts: pa.Array, width: int) -> np.ndarray:
    """The characters of texts of one width as rows of bytes."""
    return np.array(texts.to_pylist(), f"S{width}").view(np.uint8).reshape(-1, width)


def _letters(codes: np.ndarray) -> np.ndarray:
    """plain.check_letter of rows of upper-case letters and digits, as bytes."""
    places = [_ODD[codes[:, i]] if i % 2 == 0 else _EVEN[codes[:, i]] for i in range(codes.shape[1])]
    return (65 + np.sum(places, axis=0) % 26).astype(np.uint8)


def _doubled(digits: np.ndarray, first: int) -> np.ndarray:
    """Digit sums of rows of digits with every second digit doubled."""
    values = digits.astype(np.int64) - 48
    twice = values[:, first::2] * 2
    return (twice - 9 * (twice > 9)).sum(axis=1) + values[:, 1 - first :: 2].sum(axis=1)


_ODD, _EVEN = np.zeros(128, np.int64), np.zeros(128, np.int64)
for _c, _n in checksums.ODD.items():
    _ODD[ord(_c)], _EVEN[ord(_c)] = _n, int(_c, 36) - 10 * _c.isalpha()


def check_digits(acc: Column, vat10: Column, body: Column, card15: Column) -> Column:
    """iban_good, vat_digit, cf_letter and card_digit, for whole batches; the queries hold them against SQL and against the expressions."""

    def run(*columns: pa.Array) -> pa.Array:
        acc, vat, body, card = (_codes(c, n) for c, n in zip(columns, (22, 10, 15, 15)))
        letters = _letters(acc)
        # The remainder modulo 97 of letter, account, IT and 00, written in digits.
        rest = letters.astype(np.int64) - 55
        for i in range(22):
            rest = (rest * 10 + acc[:, i] - 48) % 97
        for digit in (1, 8, 2, 9, 0, 0):
            rest = (rest * 10 + digit) % 97
        whole = [f"IT{98 - r:02d}{chr(c)}{a}" for r, c, a in zip(rest.tolist(), letters.tolist(), columns[0].to_pylist())]
        made = [pa.array(whole, pa.string()), pa.array(-_doubled(vat, 1) % 10, pa.int32()), pa.array([chr(c) for c in _letters(body).tolist()], pa.string()), pa.array(-_doubled(card, 0) % 10, pa.int32())]
        return pa.StructArray.from_arrays(made, ["iban_good", "vat_digit", "cf_letter", "card_digit"])

    return per_row("struct<iban_good:string,vat_digit:int,cf_letter:string,card_digit:int>", run, acc, vat10, body, card15)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the identifiers of each order's document, some of them wrong on purpose."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("k"), "o_orderdate", "o_totalprice")
    # A small file is one task, and a join may leave few. The count comes from the file's footers; by their ids, what follows finds a document's rows together.
    j = j.repartition(max(spark.sparkContext.defaultParallelism, -(-o.count() // TASK_ROWS)), "doc_id")
    d, k = F.col("doc_id"), F.col("k")
    j = j.select(
        "*", _pad(k * 7919 % 10_000_000_000, 10).alias("vat10"), F.concat(_pad(k % 100_000, 5), _pad(d % 100_000, 5), _pad(k * 31 % 1_000_000_000_000, 12)).alias("acc"),
        F.concat(F.translate(_pad(k % 1_000_000, 6), "0123456789", LETTERS), _pad(d % 100, 2), F.substring(F.lit("ABCDEHLMPRST"), (d % 12 + 1).cast("int"), F.lit(1)), _pad(d % 28 + 1, 2), F.lit("H"), _pad(k % 900 + 100, 3)).alias("body"),
        F.concat(F.lit("4"), _pad(k % 10_000_000, 7), _pad(d % 10_000_000, 7)).alias("card15"), F.floor("o_totalprice").cast("bigint").alias("euros"),
    )
    j = j.select("*", check_digits(F.col("acc"), F.col("vat10"), F.col("body"), F.col("card15")).alias("c")).select("*", "c.*")
    wrong = lambda n: (d % n == 0).cast("int")
    last = F.substring("iban_good", 27, 1).cast("int")
    j = j.select(
        "*", F.concat("vat10", ((F.col("vat_digit") + wrong(7)) % 10).cast("string")).alias("piva"),
        F.concat("body", F.char(F.lit(65) + (F.ascii("cf_letter") - 65 + wrong(5)) % 26)).alias("cf"),
        F.concat("card15", ((F.col("card_digit") + wrong(4)) % 10).cast("string")).alias("card"),
        F.concat(F.substring("iban_good", 1, 26), ((last + wrong(11)) % 10).cast("string")).alias("iban"),
    )
    grouped = F.concat_ws(" ", *[F.substring("iban", 1 + 4 * i, 4) for i in range(7)])
    letter = lambda n, m: F.substring(F.lit("ABCDEFGHJKLMNPRSTVWXYZ"), (F.floor(n / m) % 22 + 1).cast("int"), F.lit(1))
    sep = F.when(d % 3 == 0, "").when(d % 3 == 1, " ").otherwise("-")
    thousands = F.when(F.col("euros") >= 1000, F.concat(F.floor(F.col("euros") / 1000).cast("string"), F.lit("."), _pad(F.col("euros") % 1000, 3))).otherwise(F.col("euros").cast("string"))
    return j.select(
        "doc_id", "k", "cf", "piva", "card", "iban", "iban_good", F.when(d % 3 == 0, grouped).otherwise(F.col("iban")).alias("iban_text"), (d % 3 == 0).alias("iban_is_grouped"), F.concat(F.lit("€ "), thousands, F.lit(",00")).alias("amount"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.concat(F.lit("+39 333 "), _pad(k % 1000, 3), F.lit(" "), _pad(d % 10_000, 4)).alias("phone"),
        F.concat(F.lit("cliente"), k.cast("string"), F.lit("@example.it")).alias("email"), F.concat(F.lit("https://www.example.it/c/"), k.cast("string")).alias("url"),
        F.concat(letter(d, 1), letter(d, 22), sep, _pad(d % 900 + 100, 3), sep, letter(k, 1), letter(k, 22)).alias("plate"), F.concat(F.lit("Prot. n. "), d.cast("string"), F.lit("/"), F.year("o_orderdate").cast("string")).alias("docid"),
        (d % 7 != 0).alias("piva_right"), (d % 5 != 0).alias("cf_right"), (d % 4 != 0).alias("card_right"), (d % 11 != 0).alias("iban_right"),
    )


#: The pieces of a rendered text: literal text and columns by turns.
PIECES = ("Il cliente con CF ", "cf", ", P.IVA ", "piva", ", versa ", "amount", " con carta ", "card", " sul conto ", "iban_text", ", il ", "day", ". Tel. ", "phone", "; posta ", "email", "; sito ", "url", " ; targa ", "plate", "; ", "docid", ".")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and truth (array<struct<label, start, end, value>> of what the rules should find)."""
    base = keys(spark, sf_dir)
    parts = [F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(PIECES)]
    at, truth = F.lit(0), []
    labels = {"cf": ("CF", F.lit(True)), "piva": ("PIVA", F.col("piva_right")), "amount": ("AMOUNT", F.lit(True)), "card": ("CREDITCARDNUMBER", F.col("card_right")), "iban_text": ("IBAN", F.col("iban_right")), "day": ("DATE", F.lit(True)), "phone": ("TELEPHONENUM", F.lit(True)), "email": ("EMAIL", F.lit(True)), "url": ("URL", F.lit(True)), "plate": ("TARGA", F.lit(True)), "docid": ("DOCID", F.lit(True))}
    for p, c in zip(PIECES, parts):
        if p in labels:
            label, right = labels[p]
            truth.append(F.when(right, F.struct(F.lit(label).alias("label"), at.alias("start"), (at + F.length(c)).alias("end"), c.alias("value"))))
        at = at + F.length(c)
    return base.select("doc_id", F.concat(*parts).alias("text"), F.filter(F.array(*truth), lambda t: t.isNotNull()).alias("truth"))


# The same in SQL ---------------------------------------------------------------------------------------------------------------
_A36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sql_value36(c: str) -> str:
    return f"(strpos('{_A36}', {c}) - 1)"


def sql_chars(s: str) -> str:
    return f"regexp_extract_all({s}, '.')"


def sql_sum(numbers: str) -> str:
    return f"list_sum({numbers})::BIGINT"


def sql_mod97(s: str) -> str:
    return f"list_reduce(list_prepend(0, list_transform({sql_chars(s)}, lambda c: {sql_value36('c')}::BIGINT)), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"


def sql_doubled(s: str, first: int) -> str:
    return sql_sum(f"list_transform({sql_chars(s)}, lambda c, i: CASE WHEN (i - 1) % 2 = {first} THEN c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END ELSE c::INT END)")


def sql_check_letter(s: str) -> str:
    odd = "[" + ", ".join(str(checksums.ODD[c]) for c in _A36) + "]"
    even = f"CASE WHEN {sql_value36('c')} < 10 THEN {sql_value36('c')} ELSE {sql_value36('c')} - 10 END"
    return f"chr((65 + {sql_sum(f'list_transform({sql_chars(s)}, lambda c, i: CASE WHEN (i - 1) % 2 = 0 THEN {odd}[{sql_value36(chr(99))} + 1] ELSE {even} END)')} % 26)::INT)"


def sql_iban_ok(s: str) -> str:
    return f"({sql_mod97(f'substr({s}, 5) || substr({s}, 1, 4)')} = 1)"


def sql_vat_ok(s: str) -> str:
    return f"((10 - {sql_doubled(f'substr({s}, 1, 10)', 1)} % 10) % 10 = substr({s}, 11, 1)::INT)"


def sql_cf_ok(s: str) -> str:
    return f"({sql_check_letter(f'substr({s}, 1, 15)')} = substr({s}, 16, 1))"


def sql_luhn_ok(s: str) -> str:
    return f"({sql_sum(f'list_transform(list_reverse({sql_chars(s)}), lambda c, i: CASE WHEN i % 2 = 0 THEN c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END ELSE c::INT END)')} % 10 = 0)"


def sql_keys() -> str:
    """CTEs up to rk(doc_id, k, cf, piva, ...): the rows of keys()."""
    pad = lambda x, n: f"lpad(({x})::VARCHAR, {n}, '0')"
    letter = lambda n, m: f"substr('ABCDEFGHJKLMNPRSTVWXYZ', (({n} // {m}) % 22 + 1)::INT, 1)"
    sep = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '-' END"
    return f"""
rk0 AS (SELECT o.o_orderkey AS doc_id, o.o_custkey AS k, o.o_orderdate, floor(o.o_totalprice)::BIGINT AS euros FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
rk1 AS (SELECT *, {pad('k * 7919 % 10000000000', 10)} AS vat10, {pad('k % 100000', 5)} || {pad('doc_id % 100000', 5)} || {pad('k * 31 % 1000000000000', 12)} AS acc,
  translate({pad('k % 1000000', 6)}, '0123456789', '{LETTERS}') || {pad('doc_id % 100', 2)} || substr('ABCDEHLMPRST', (doc_id % 12 + 1)::INT, 1) || {pad('doc_id % 28 + 1', 2)} || 'H' || {pad('k % 900 + 100', 3)} AS body,
  '4' || {pad('k % 10000000', 7)} || {pad('doc_id % 10000000', 7)} AS card15 FROM rk0),
rk2 AS (SELECT *, {sql_check_letter('acc')} || acc AS bban, (10 - {sql_doubled('vat10', 1)} % 10) % 10 AS vat_digit, {sql_check_letter('body')} AS cf_letter, (10 - {sql_doubled('card15', 0)} % 10) % 10 AS card_digit FROM rk1),
rk3 AS (SELECT *, 'IT' || {pad('98 - ' + sql_mod97("(bban || 'IT00')"), 2)} || bban AS iban_good FROM rk2),
rk4 AS (SELECT *, vat10 || ((vat_digit + (doc_id % 7 = 0)::INT) % 10)::VARCHAR AS piva, body || chr((65 + (ascii(cf_letter) - 65 + (doc_id % 5 = 0)::INT) % 26)::INT) AS cf,
  card15 || ((card_digit + (doc_id % 4 = 0)::INT) % 10)::VARCHAR AS card, substr(iban_good, 1, 26) || ((substr(iban_good, 27, 1)::INT + (doc_id % 11 = 0)::INT) % 10)::VARCHAR AS iban FROM rk3),
rk AS (SELECT doc_id, k, cf, piva, card, iban, iban_good, CASE WHEN doc_id % 3 = 0 THEN {" || ' ' || ".join(f"substr(iban, {1 + 4 * i}, 4)" for i in range(7))} ELSE iban END AS iban_text, doc_id % 3 = 0 AS iban_is_grouped,
  '€ ' || CASE WHEN euros >= 1000 THEN (euros // 1000)::VARCHAR || '.' || {pad('euros % 1000', 3)} ELSE euros::VARCHAR END || ',00' AS amount, strftime(o_orderdate, '%d/%m/%Y') AS day,
  '+39 333 ' || {pad('k % 1000', 3)} || ' ' || {pad('doc_id % 10000', 4)} AS phone, 'cliente' || k::VARCHAR || '@example.it' AS email, 'https://www.example.it/c/' || k::VARCHAR AS url,
  {letter('doc_id', 1)} || {letter('doc_id', 22)} || {sep} || {pad('doc_id % 900 + 100', 3)} || {sep} || {letter('k', 1)} || {letter('k', 22)} AS plate, 'Prot. n. ' || doc_id::VARCHAR || '/' || year(o_orderdate)::VARCHAR AS docid,
  doc_id % 7 <> 0 AS piva_right, doc_id % 5 <> 0 AS cf_right, doc_id % 4 <> 0 AS card_right, doc_id % 11 <> 0 AS iban_right FROM rk4),
rendered AS (SELECT rk.*, {" || ".join(p if i % 2 else "'" + p + "'" for i, p in enumerate(PIECES))} AS text FROM rk)"""
