"""Spans in texts as arrays of structs, found and worked on inside a row by built-in functions.

A span is struct<label, start, end, score, validated, source, ord>; offsets count code points, and the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velatura.functions.classes import SPACE, WORD

MARK = "\x01"
_BLOCK = 64
SPAN = "struct<label:string,start:int,end:int,score:double,validated:boolean,source:string,ord:int>"
VALUE = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value evaluated once. An expression that uses another in several places, or inside a lambda, holds and
    evaluates it each time, and nested ones grow as a power of the depth."""
    return F.get(F.transform(F.array(value), body), 0)


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, leftmost and not overlapping.

    The JVM's replacement marks each match on both sides, and a split at the marks gives texts and matches by turns; starts are
    sums of lengths, kept for every 64th part and summed from there, so that the work grows with the number of matches. Marks
    in the text itself count as spaces. The pattern may not have capturing groups.
    """
    clean = F.translate(text, MARK, " ")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    block = lambda k: F.floor(k / _BLOCK).cast("int")

    def bases(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), block(F.size(x["n"]) - 1)), lambda b: total(F.slice(x["n"], b * _BLOCK + 1, _BLOCK)))
        grow = lambda a, s: F.struct((a["at"] + s).alias("at"), F.array_append(a["all"], a["at"] + s).alias("all"))
        return F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all")), grow, lambda a: a["all"])

    def matches(x: Column, base: Column) -> Column:
        start = lambda k: F.get(base, block(k)) + total(F.slice(x["n"], block(k) * _BLOCK + 1, k % _BLOCK))
        one = lambda k: let(start(k), lambda at: F.struct(at.alias("start"), (at + F.get(x["n"], k)).alias("end"), F.get(x["p"], k).alias("value")))
        return F.transform(F.sequence(F.lit(1), F.size(x["p"]) - 2, F.lit(2)), one)

    none = F.array().cast(f"array<{VALUE}>")
    placed = lambda p: let(F.struct(p.alias("p"), F.transform(p, F.length).alias("n")), lambda x: let(bases(x), lambda base: matches(x, base)))
    return let(parts, lambda p: F.when(F.size(p) > 2, placed(p)).otherwise(none))


def span(label: Column, start: Column, end: Column, score: Column, validated: Column, source: Column, ord_: Column) -> Column:
    return F.struct(
        label.cast("string").alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"),
        validated.cast("boolean").alias("validated"), source.cast("string").alias("source"), ord_.cast("int").alias("ord"),
    )


def moved(s: Column, start: Column | None = None, end: Column | None = None) -> Column:
    return span(s["label"], s["start"] if start is None else start, s["end"] if end is None else end, s["score"], s["validated"], s["source"], s["ord"])


def cut_out(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def select_greedy(spans: Column, soft: Column) -> Column:
    """Spans kept one by one in order of priority, if they touch none kept before: validated ones, then rules whose shape is
    evidence (soft labels' isn't), then the score, then the length; ties by ord."""
    strong = lambda s: (s["source"] == "regex") & ~F.array_contains(soft, s["label"])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
        F.when(s["validated"], 0).otherwise(1).alias("a"), F.when(strong(s), 0).otherwise(1).alias("b"), (-s["score"]).alias("c"),
        (s["start"] - s["end"]).alias("d"), s["ord"].alias("e"), s.alias("s"),
    )))
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (k["end"] > s["start"]))
    return F.aggregate(ranked, F.array().cast(f"array<{SPAN}>"), lambda kept, r: F.when(free(kept, r["s"]), F.array_append(kept, r["s"])).otherwise(kept))


def in_order(spans: Column) -> Column:
    """Disjoint spans by their places."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s.alias("s")))), lambda r: r["s"])


def trim_space(spans: Column, text: Column) -> Column:
    """Without white space at both ends; what is only white space goes."""
    lead = lambda v: F.length(v) - F.length(F.regexp_replace(v, f"^[{SPACE}]+", ""))
    tail = lambda v: F.length(v) - F.length(F.regexp_replace(v, f"[{SPACE}]+$", ""))
    value = lambda s: cut_out(text, s["start"], s["end"])
    cut = F.transform(spans, lambda s: moved(s, s["start"] + lead(value(s)), s["end"] - tail(value(s))))
    return F.filter(cut, lambda s: s["end"] > s["start"])


def widen_to_words(spans: Column, text: Column) -> Column:
    """An edge inside a word moves out to the word's end."""

    def wide(s: Column) -> Column:
        first, last = F.substring(text, s["start"] + 1, 1), F.substring(text, s["end"], 1)
        before = F.length(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), s["start"])), f"^[{WORD}]*", 0))
        after = F.length(F.regexp_extract(F.substring(text, s["end"] + 1, F.length(text)), f"^[{WORD}]*", 0))
        return moved(s, s["start"] - F.when(first.rlike(f"[{WORD}]"), before).otherwise(0), s["end"] + F.when(last.rlike(f"[{WORD}]"), after).otherwise(0))

    return F.transform(spans, wide)


def fuse(spans: Column) -> Column:
    """In the order of places, longer ones first, ties as they come: a span that overlaps the one before it, or touches it under the same label, becomes part of it."""
    by_place = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), i.alias("i"), s.alias("s"))))
    none = F.struct(F.array().cast(f"array<{SPAN}>").alias("done"), F.lit(None).cast(SPAN).alias("open"))

    def step(a: Column, r: Column) -> Column:
        s, o = r["s"], a["open"]
        joins = o.isNotNull() & ((s["start"] < o["end"]) | ((s["start"] == o["end"]) & (s["label"] == o["label"])))
        done = F.when(o.isNull() | joins, a["done"]).otherwise(F.array_append(a["done"], o))
        return F.struct(done.alias("done"), F.when(joins, moved(o, end=F.greatest(o["end"], s["end"]))).otherwise(s).alias("open"))

    return F.aggregate(by_place, none, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


#: Characters whose full case folding is not their lower case, of those that texts hold.
_FOLDS = {"ß": "ss", "ẞ": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn"}


def fold(value: Column) -> Column:
    """The form under which values are the same: one space for each run of white space, none at the ends, case folded."""
    flat = F.regexp_replace(F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+", " ")
    out = F.translate(F.lower(flat), "ςſ", "σs")
    for a, b in _FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def exploded(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """A row for each element of a computed array. A plain explode lets the optimizer filter on the array's size below all
    projections, which computes the array a second time; the outer form doesn't, and empty arrays go by their null."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
