"""Tokens and their labels: B- begins an entity, I- goes on with one, O is outside."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velatura.functions import checksums
from velatura.functions.classes import SPACE, WORD
from velatura.functions.spans import cut_out, exploded, find, let
from velatura.functions.taxonomy import ADMITTED, RECASED, SPAN_CORPUS, final_label, mapping

TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]"


def tokens(text: Column) -> Column:
    """Words, and other characters one by one."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def token_spans(text: Column) -> Column:
    """array<struct<start, end, value>> of the same tokens."""
    return find(text, TOKEN)


def bio_labels(spans: Column, entities: Column) -> Column:
    """A label for each token: of the first entity that holds it whole, beginning it if both start at one place."""

    def one(entities: Column, t: Column) -> Column:
        first = F.get(F.filter(entities, lambda e: (e["start"] <= t["start"]) & (t["end"] <= e["end"])), 0)
        return let(first, lambda e: F.when(e.isNull(), "O").otherwise(F.concat(F.when(e["start"] == t["start"], "B-").otherwise("I-"), e["label"])))

    return let(entities, lambda every: F.transform(spans, lambda t: one(every, t)))


def bio_from_spans(spans: Column, entities: Column, table: dict[str, str] = SPAN_CORPUS) -> Column:
    """As bio_labels, for a corpus whose labels carry a number (NAME_1) and map through a table: an entity's first whole token
    begins it, later entities win over earlier ones, and labels outside the table are dropped."""
    known = F.filter(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.element_at(mapping(table), F.regexp_replace(e["label"], "_[^_]*$", "")).alias("label"))), lambda e: e["label"].isNotNull())

    def one(spans: Column, known: Column, t: Column, i: Column) -> Column:
        # A token begins its entity if the token before it starts outside.
        label = lambda e: F.concat(F.when(F.when(i > 0, F.get(spans, i - 1)["start"] >= e["start"]), "I-").otherwise("B-"), e["label"])
        last = F.try_element_at(F.filter(known, lambda e: (e["start"] <= t["start"]) & (t["end"] <= e["end"])), F.lit(-1))
        return F.coalesce(let(last, lambda e: F.when(e.isNotNull(), label(e))), F.lit("O"))

    return let(F.struct(known.alias("known"), spans.alias("spans")), lambda x: F.transform(x["spans"], lambda t, i: one(x["spans"], x["known"], t, i)))


def decode_spans(literal: Column) -> Column:
    """array<struct<start, end, label>> of a text like [(0, 5, 'NAME_1'), ...], read by pattern and never evaluated; O goes."""
    part = lambda k: F.regexp_extract_all(literal, F.lit(r"\(\s*(\d+)\s*,\s*(\d+)\s*,\s*['\"]([^'\"]*)['\"]\s*\)"), k)
    every = F.zip_with(F.arrays_zip(part(1).alias("a"), part(2).alias("b")), part(3), lambda p, label: F.struct(p["a"].cast("int").alias("start"), p["b"].cast("int").alias("end"), label.alias("label")))
    return F.filter(every, lambda e: e["label"] != "O")


def label_type(label: Column) -> Column:
    """The label without B- or I-; null for O."""
    return F.when(label != "O", F.substring(label, F.lit(3), F.length(label)))


def normalise(labels: Column) -> Column:
    """Labels mapped to final ones; a token of the same type as the one before goes on with it, whatever its own mark was."""
    types = F.transform(labels, lambda x: final_label(label_type(x)))

    def marked(types: Column) -> Column:
        goes_on = lambda t, i: F.when(i > 0, F.get(types, i - 1)).eqNullSafe(t)
        return F.transform(types, lambda t, i: F.when(t.isNull(), "O").otherwise(F.concat(F.when(goes_on(t, i), "I-").otherwise("B-"), t)))

    return let(types, marked)


def tags_of(labels: Column) -> Column:
    """The distinct types of a row."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, label_type), lambda t: t.isNotNull())))


def label_spans(labels: Column) -> Column:
    """array<struct<type, start, end>> over token numbers; a type that changes ends a span, and an I- without one begins it."""
    def spans(labels: Column, types: Column) -> Column:
        return let(types, lambda t: ends_and_starts(labels, t))

    def ends_and_starts(labels: Column, types: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(types, i - 1))
        opens = lambda i: F.get(labels, i).startswith("B-") | before(i).isNull() | (before(i) != F.get(types, i))
        starts = F.filter(F.transform(types, lambda t, i: F.when(t.isNotNull() & opens(i), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(types, lambda t, i: F.when(t.isNotNull() & ((i == F.size(labels) - 1) | F.get(types, i + 1).isNull() | opens(i + 1)), i + 1)), lambda i: i.isNotNull())
        return F.zip_with(starts, ends, lambda s, e: F.struct(F.get(types, s).alias("type"), s.alias("start"), e.alias("end")))

    return let(labels, lambda x: spans(x, F.transform(x, label_type)))


def label_span_rows(rows: DataFrame, id_col: str = "row_id", labels_col: str = "bio_labels") -> DataFrame:
    """The spans of label_spans as rows: id, type, start, end; found within each row in time linear in its tokens, which stay where they are."""
    from velatura.operators.rows import label_spans_column

    return exploded(rows, [id_col], label_spans_column(F.col(labels_col)), "s").select(id_col, "s.*")


def label_vocabulary(rows: DataFrame, labels_col: str = "bio_labels") -> DataFrame:
    """label, label_id: all labels of the rows, with an I- for every B-, numbered in their order."""
    seen = rows.select(F.explode(labels_col).alias("label")).distinct()
    inner = seen.filter(F.col("label").startswith("B-")).select(F.concat(F.lit("I-"), F.expr("substring(label, 3)")).alias("label"))
    every = seen.unionByName(inner).distinct()
    # A vocabulary has twice as many rows as there are kinds of entity, so numbering it in one place is bounded.
    return every.withColumn("label_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint"))


def propagate(labels: Column, word_ids: Column, all_pieces: bool = True) -> Column:
    """A label for each piece of a tokenizer (word_ids: its word, null for special pieces): the word's on its first piece, then its
    continuation; null where a piece doesn't count."""

    def one(labels: Column, word_ids: Column, w: Column, i: Column) -> Column:
        own = F.get(labels, w)
        first = ~F.when(i > 0, F.get(word_ids, i - 1)).eqNullSafe(w)
        inner = F.regexp_replace(own, "^B-", "I-") if all_pieces else F.lit(None).cast("string")
        return F.when(w.isNull(), F.lit(None).cast("string")).when(first, own).otherwise(inner)

    return let(F.struct(labels.alias("l"), word_ids.alias("w")), lambda x: F.transform(x["w"], lambda w, i: one(x["l"], x["w"], w, i)))


def draw(*parts) -> Column:
    """A number from 0 to 1 that depends on nothing but the parts: seed, row, place."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 40)).cast("double") / float(1 << 40)


def recase(words: Column, labels: Column, row: Column, seed: int = 0) -> Column:
    """A row's tokens under changed case, for training: 35 % all lower, 10 % all upper, 8 % either for each token, 22 % only the
    tokens of names and places (lower, upper or capitalised), 25 % as they are. Draws depend on seed and row."""
    r, how = draw(seed, row, F.lit("recase")), draw(seed, row, F.lit("how"))
    capital = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))
    coin = lambda i: draw(seed, row, i, F.lit("coin")) < 0.5

    def name(t: Column, i: Column) -> Column:
        own = F.coalesce(label_type(F.get(labels, i)).isin(*RECASED), F.lit(False))
        return F.when(own, F.when(how < 1 / 3, F.lower(t)).when(how < 2 / 3, F.upper(t)).otherwise(capital(t))).otherwise(t)

    return (
        F.when(r < 0.35, F.transform(words, F.lower)).when(r < 0.45, F.transform(words, F.upper))
        .when(r < 0.53, F.transform(words, lambda t, i: F.when(coin(i), F.upper(t)).otherwise(F.lower(t))))
        .when(r < 0.75, F.transform(words, name)).otherwise(words)
    )


def first_error(text: Column, words: Column, labels: Column, entities: Column) -> Column:
    """What is wrong with an example, or null: lengths, labels outside the taxonomy, places, checksums, in this order."""
    return let(F.struct(text.alias("t"), words.alias("w"), labels.alias("l"), entities.alias("e")), lambda x: _first_error(x["t"], x["w"], x["l"], x["e"]))


def _first_error(text: Column, words: Column, labels: Column, entities: Column) -> Column:
    admitted = F.array(*[F.lit(x) for x in ADMITTED])
    strange = lambda label: ~F.array_contains(admitted, label)
    bad = lambda label, ok: F.exists(entities, lambda e: (e["label"] == label) & ~ok(e["value"]))
    return (
        F.when(F.size(words) != F.size(labels), "length")
        .when(F.exists(labels, lambda x: (x != "O") & strange(F.substring(x, F.lit(3), F.length(x)))), "bio label")
        .when(F.exists(entities, lambda e: ~cut_out(text, e["start"], e["end"]).eqNullSafe(e["value"])), "offset")
        .when(F.exists(entities, lambda e: strange(e["label"])), "entity label")
        .when(bad("CF", checksums.tax_code_ok), "cf").when(bad("PIVA", checksums.vat_ok_strict), "piva").when(bad("IBAN", checksums.iban_ok), "iban")
    )


def derivation_error(text: Column, words: Column, labels: Column, entities: Column) -> Column:
    """As first_error, for examples whose tokens and labels must be those that text and entities give."""
    return let(F.struct(text.alias("t"), words.alias("w"), labels.alias("l"), entities.alias("e")), lambda x: _derivation_error(x["t"], x["w"], x["l"], x["e"]))


def _derivation_error(text: Column, words: Column, labels: Column, entities: Column) -> Column:
    return (
        F.when(words != tokens(text), "tokens").when(F.size(words) != F.size(labels), "length")
        .when(F.exists(entities, lambda e: ~cut_out(text, e["start"], e["end"]).eqNullSafe(e["value"])), "offset")
        .when(labels != bio_labels(token_spans(text), entities), "labels")
        .when(F.exists(entities, lambda e: (e["label"] == "PIVA") & ~checksums.vat_ok_strict(e["value"])), "piva")
    )


def derivation_error_arrow(text: Column, words: Column, labels: Column, entities: Column) -> Column:
    """derivation_error as an Arrow function, in time linear in the text; entities are structs of value, label, start and end."""
    from velatura.functions import plain
    from velatura.operators import rows

    def one(text: str, words: list, labels: list, entities: list[tuple]) -> str | None:
        own = rows.tokens(text)
        if words != [w for w, _, _ in own]:
            return "tokens"
        if len(words) != len(labels):
            return "length"
        if any(text[a:b] != value for value, _, a, b in entities):
            return "offset"
        if labels != rows.bio_labels(own, [(a, b, label) for _, label, a, b in entities]):
            return "labels"
        return "piva" if any(label == "PIVA" and not (value.isdigit() and plain.vat_ok(value)) for value, label, _, _ in entities) else None

    def run(texts: pa.Array, words: pa.Array, labels: pa.Array, entities: pa.Array) -> pa.Array:
        return pa.array([one(t or "", w or [], x or [], e) for t, w, x, e in zip(texts.to_pylist(), words.to_pylist(), labels.to_pylist(), rows.tuples(entities))], pa.string())

    return rows.per_row("string", run, text, words, labels, entities)
