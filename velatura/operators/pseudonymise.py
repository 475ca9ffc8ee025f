"""From candidates to a pseudonymised text: selection, numbering, dictionary, rewriting, statistics and restoring.

All steps stay inside a row, so a whole run over documents is one narrow stage without a shuffle. Steps that carry state along a text run
as Arrow functions (operators.rows), in time linear in the text; as expressions they would scan what they have kept for each
span. `merge` and `select_greedy` also exist as expressions only (engine="native"), for clusters without Python workers.
"""

from __future__ import annotations

import re
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velatura.functions.classes import SPACE, WORD
from velatura.functions.spans import SPAN, exploded, fuse, in_order, select_greedy, trim_space, widen_to_words
from velatura.operators import rows
from velatura.operators.detect import DETECTORS, SOFT_LABELS, Detector

#: Words of a window that a recogniser reads at once, and words that two windows share.
WINDOW_WORDS, SHARED_WORDS = 120, 20


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WINDOW_WORDS, shared: int = SHARED_WORDS) -> DataFrame:
    """id, chunk, start, end, text of every window of every document: so many words, of which two windows share some, whole words only, the last one
    ending with the text's last word. A text without words has none."""
    return exploded(docs, [id_col], rows.windows_column(F.col(text_col), words, shared), "w").select(id_col, "w.*")


def recognise(docs: DataFrame, recogniser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A recogniser's candidates with places in the whole text: id, candidates.

    recogniser: texts of windows (a list) to a list of lists of (label, start, end, score), called on Arrow batches. The
    windows overlap, so a span may come twice; selection keeps one of them.
    """

    def run(batches):
        for pdf in batches:
            found = recogniser(pdf["text"].tolist())
            out = [(i, [{"label": label, "start": a + o, "end": b + o, "score": s, "validated": False, "source": "model"} for label, a, b, s in spans if b > a]) for i, o, spans in zip(pdf["id"], pdf["start"], found)]
            yield pd.DataFrame({"id": [i for i, _ in out], "spans": [s for _, s in out]})

    windows = chunk_rows(docs, id_col, text_col).select(F.col(id_col).alias("id"), "start", "text")
    each = windows.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<label:string,start:int,end:int,score:double,validated:boolean,source:string>>")
    joined = each.groupBy("id").agg(F.flatten(F.array_sort(F.collect_list("spans"))).alias("spans"))
    spans = F.transform("spans", lambda s, i: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["validated"].alias("validated"), s["source"].alias("source"), i.alias("ord")))
    return joined.select(F.col("id").alias(id_col), spans.cast(f"array<{SPAN}>").alias("model_candidates"))


def exclude(candidates: Column, labels: list[str]) -> Column:
    """Without candidates of these labels, before selection: they neither count nor stand in another's way."""
    unwanted = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    return F.filter(candidates, lambda c: ~F.array_contains(unwanted, c["label"]))


def find_candidates(docs: DataFrame, detectors: tuple[Detector, ...] = DETECTORS, grouped_iban: bool = True, text_col: str = "text", out: str = "candidates") -> DataFrame:
    """The rows with the candidates of the rule net, for the steps below. (A planner of Spark 4.1 can't evaluate Arrow functions over columns that
    hold nested lambdas, as those of operators.detect do.)"""
    return docs.withColumn(out, rows.detect_column(F.col(text_col), detectors, grouped_iban))


def merge(df: DataFrame, candidates_col: str = "candidates", text_col: str = "text", out: str = "spans", soft: tuple[str, ...] = SOFT_LABELS, engine: str = "arrow") -> DataFrame:
    """The rows with disjoint spans in the order of places: selected by priority, trimmed, widened to whole words, and fused."""
    text = F.col(text_col)
    if engine == "arrow":
        return df.withColumn(out, rows.merge_column(text, F.col(candidates_col), soft))
    chosen = select_greedy(F.col(candidates_col), F.array(*[F.lit(s) for s in soft]))
    some = lambda c, make: F.when(F.size(c) > 0, make(c)).otherwise(F.array().cast(f"array<{SPAN}>"))
    df = df.withColumn(out, F.when(F.size(candidates_col) > 0, in_order(chosen)).otherwise(F.array().cast(f"array<{SPAN}>")))
    df = df.withColumn(out, some(F.col(out), lambda c: trim_space(c, text)))
    df = df.withColumn(out, some(F.col(out), lambda c: widen_to_words(c, text)))
    return df.withColumn(out, some(F.col(out), fuse))


def number(df: DataFrame, spans_col: str = "spans", text_col: str = "text", out: str = "entities") -> DataFrame:
    """The rows with array<struct<label, start, end, value, placeholder, source, validated, first>>.

    Within a document, equal values (folded) of a label share a placeholder [LABEL_k], numbered by first occurrence.
    """
    return df.withColumn(out, rows.number_column(F.col(text_col), F.col(spans_col)))


def rewrite(df: DataFrame, reversible: bool = True, entities_col: str = "entities", text_col: str = "text") -> DataFrame:
    """The rows with anonymized_text, mapping (placeholder to first value; empty if irreversible) and segments.

    Segments alternate literal texts and entities; irreversible ones don't hold an entity's text.
    """
    return df.select("*", rows.rewrite_column(F.col(text_col), F.col(entities_col), reversible).alias("__rewritten")).select("*", "__rewritten.*").drop("__rewritten")


def statistics(df: DataFrame, entities_col: str = "entities", text_col: str = "text") -> DataFrame:
    """The rows with n_chunks, n_chars, n_entities, n_unique, by_label and by_source."""
    e = F.col(entities_col)
    words = F.size(F.regexp_extract_all(F.col(text_col), F.lit(f"([^{SPACE}]+)"), 1))
    step = WINDOW_WORDS - SHARED_WORDS
    tally = lambda name: F.map_from_entries(F.transform(F.array_distinct(F.transform(e, lambda x: x[name])), lambda v: F.struct(v, F.size(F.filter(e, lambda x: x[name] == v)).cast("bigint"))))
    return (
        df.withColumn("n_chunks", F.when(words > 0, F.ceil(F.greatest(words - WINDOW_WORDS, F.lit(0)) / F.lit(step)) + 1).otherwise(0).cast("bigint"))
        .withColumn("n_chars", F.length(text_col).cast("bigint")).withColumn("n_entities", F.size(e).cast("bigint"))
        .withColumn("n_unique", F.size(F.filter(e, lambda x: x["first"])).cast("bigint")).withColumn("by_label", tally("label")).withColumn("by_source", tally("source"))
    )


def analyse(docs: DataFrame, excluded: list[str] | None = None, reversible: bool = True, model: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Detection to statistics for every document, in one Arrow function. model: (id, model_candidates) of a recogniser; they come before the rules'."""
    found, given = docs, None
    if model is not None:
        found, given = docs.join(model, id_col, "left"), F.col("model_candidates")
    made = rows.analyse_column(F.col(text_col), given, excluded or [], reversible, WINDOW_WORDS, SHARED_WORDS)
    done = found.select(*[F.col(c) for c in docs.columns], made.alias("__made")).select(*docs.columns, "__made.*")
    return done.withColumn("excluded_tags", F.array(*[F.lit(x) for x in sorted(excluded or [])]).cast("array<string>"))


def dictionary(analysed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The dictionary as rows: id, placeholder, label, value. It restores the texts, so it belongs in a place of its own."""
    return exploded(analysed, [id_col], F.filter("entities", lambda e: e["first"]), "e").select(id_col, F.col("e.placeholder").alias("placeholder"), F.col("e.label").alias("label"), F.col("e.value").alias("value"))


def simple_mask(df: DataFrame, spans_col: str = "spans", text_col: str = "text", out: str = "masked") -> DataFrame:
    """Each span as [LABEL], without numbers."""
    return df.withColumn(out, rows.mask_column(F.col(text_col), F.col(spans_col)))


def restore(text: Column, mapping: Column, segments: Column | None = None) -> Column:
    """The text with every placeholder replaced by its value; see rows.restore. With the segments of its rewriting, a text that nobody has changed
    since comes back exactly: a name gives back the first of several spellings only, and takes asterisks around it and look-alikes along."""
    return rows.restore_column(text, mapping, segments)


def glued_placeholder(text: Column) -> Column:
    """Whether some placeholder touches a word character."""
    return F.coalesce(text.rlike(rf"\[[A-Z_]+_[0-9]+\][{WORD}]|[{WORD}]\[[A-Z_]+_[0-9]+\]"), F.lit(False))


# --- scrubbing a text with a given dictionary --------------------------------------------------------------------------------

#: Between any two characters of a value: a word broken at a line's end.
_BREAK = r"(?:[\xad‐-]?[ \t]*\n[ \t]*)?"
#: Letters and digits that a value must have to be looked for without word boundaries at an edge of punctuation.
_UNANCHORED = 4
#: Entries up to which plain values are looked for one by one, and characters that fold to ASCII ones in a search without case.
_FEW, _FOLDED_TO_ASCII = 8, re.compile("[\u0130\u0131\u017f\u212a]")


def value_pattern(value: str, breaks: bool = True) -> str:
    """Pattern of a dictionary value in running text: its characters, flexible white space, breaks at line ends (a text without
    line ends needs none), word boundaries."""
    words = value.split()
    body = r"\s+".join((_BREAK if breaks else "").join(re.escape(c) for c in w) for w in words)
    core = sum(c.isalnum() for c in value)
    flat = value.strip()
    inner = lambda c: c.isalnum() or c == "_"
    left = r"(?<!\w)" if flat and (inner(flat[0]) or core < _UNANCHORED) else ""
    right = r"(?!\w)" if flat and (inner(flat[-1]) or core < _UNANCHORED) else ""
    return left + body + right


def worth_searching(value: Column) -> Column:
    """Not under two letters or digits, and not just two digits: such a value would be found everywhere."""
    core = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    return (F.length(core) >= 2) & ~core.rlike(r"^\p{N}{2}$")


class Scrubber:
    """All values of one dictionary as two patterns (values that need a word boundary on the left, and others), each a tree of characters, so that
    values with a common beginning are tried together."""

    def __init__(self, entries: list[tuple[str, str]], breaks: bool):
        """entries: (placeholder, value), the most important first; of equal values the first counts."""
        self.entries, self.breaks = entries, breaks
        # Compiling patterns takes longer than to look for a few plain values one by one.
        plain = not breaks and len(entries) <= _FEW and all(v.isascii() and len(v.split()) == 1 for _, v in entries)
        self.plain = [(k, v.strip().lower(), *self._edges(v)) for k, (_, v) in enumerate(entries)] if plain else None

    @staticmethod
    def _edges(value: str) -> tuple[bool, bool]:
        """Whether a value needs a word boundary on the left and on the right."""
        core, flat = sum(c.isalnum() for c in value), value.strip()
        edge = lambda c: c.isalnum() or c == "_" or core < _UNANCHORED
        return edge(flat[0]), edge(flat[-1])

    @cached_property
    def patterns(self) -> list[tuple[re.Pattern, list[int]]]:
        entries = self.entries
        trees: dict[tuple[str, str], dict] = {}
        for k, (_, value) in enumerate(entries):
            left, right = self._edges(value)
            node = trees.setdefault(r"(?<!\w)" if left else "", {})
            for i, word in enumerate(value.split()):
                for c in ([" "] if i else []) + list(word):
                    node = node.setdefault(c if c == " " or len(c.lower()) > 1 else c.lower(), {})
            node.setdefault("", (k, r"(?!\w)" if right else ""))
        patterns: list[tuple[re.Pattern, list[int]]] = []
        for left, tree in trees.items():
            order: list[int] = []  # entry of each group
            patterns.append((re.compile(left + self._emit(tree, order), re.I), order))
        return patterns

    def _emit(self, node: dict, order: list[int], inside: bool = False) -> str:
        """A node's alternatives, longer values before the one that ends here. inside: the character before belongs to the same word."""
        out = []
        while len(node) == 1 and "" not in node:
            (c, node), = node.items()
            out += [_BREAK if inside and c != " " and self.breaks else "", r"\s+" if c == " " else re.escape(c)]
            inside = c != " "
        ways = [self._emit({c: below}, order, inside) for c, below in node.items() if c]
        if "" in node:  # its group comes after those of the longer ones
            order.append(node[""][0])
            ways.append(node[""][1] + "()")
        return "".join(out) + (ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})")

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(entry, start, end): at each place the longest value of each pattern that begins there."""
        if self.plain is not None and not _FOLDED_TO_ASCII.search(text):
            return self._found_plain(text)
        out = []
        for pattern, order in self.patterns:
            at = 0
            while m := pattern.search(text, at):
                out.append((order[m.lastindex - 1], m.start(), m.end()))
                at = m.start() + 1
        return out

    def _found_plain(self, text: str) -> list[tuple[int, int, int]]:
        """The same for plain values: nothing but its own lower and upper case matches an ASCII character here."""
        low, best = text.lower(), {}
        inner = lambda c: c.isalnum() or c == "_"
        for k, value, left, right in self.plain:
            at = low.find(value)
            while at >= 0:
                end = at + len(value)
                if not (left and at and inner(text[at - 1])) and not (right and end < len(text) and inner(text[end])):
                    if (left, at) not in best or end > best[left, at][2]:
                        best[left, at] = (k, at, end)
                at = low.find(value, at + 1)
        return list(best.values())

    def replace(self, text: str, counts: list[int]) -> str:
        """The text with values replaced, more important ones first where they overlap, until none is left: what stands next to a replaced
        value is set off from it."""
        hits = sorted(self.found(text))
        if not hits:
            return text
        taken, kept = bytearray(len(text)), []
        for k, a, b in hits:
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\x01" * (b - a)
                kept.append((a, b, k))
                counts[k] += 1
        out, at = [], 0
        for a, b, k in [*sorted(kept), (len(text), len(text), -1)]:
            out.append(self.replace(text[at:a], counts) if a > at else "")
            out.append(self.entries[k][0] if k >= 0 else "")
            at = b
        return "".join(out)


def scrub_text(text: str, entries: list[tuple[str, str, bool]]) -> tuple[str, dict[str, int], list[str], list[str], list[str]]:
    """scrubbed, occurrences, not_found, skipped and residual of one text; entries: (placeholder, value, whether to search for it)."""
    entries = sorted(entries, key=lambda e: (-len(e[1]), e[0]))
    used = [(name, value) for name, value, use in entries if use]
    scrubber, counts = Scrubber(used, "\n" in text), [0] * len(used)
    done = scrubber.replace(text, counts)
    totals: dict[str, int] = {}
    for (name, _), n in zip(used, counts):
        totals[name] = totals.get(name, 0) + n
    bare = re.sub(r"\[[A-Z_]+_\d+\]", "\0", done)  # what stands on both sides of a placeholder is not one value
    residual = []
    if scrubber.found(bare):  # which ones is told by each value's own pattern
        residual = [name for name, value in used if re.search(value_pattern(value, "\n" in text), bare, re.I)]
    return done, totals, sorted(n for n, c in totals.items() if not c), sorted(n for n, _, use in entries if not use), sorted(residual)


def scrub(texts: DataFrame, entries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with the values of their document's dictionary (id, placeholder, value) replaced, longest first, and what was found:
    scrubbed, occurrences (placeholder to count), not_found, skipped, residual (placeholders whose value is still readable).

    Each document's own dictionary is gathered with it; a document without one stays as it is.
    """
    gathered = entries.groupBy(id_col).agg(F.collect_list(F.struct("placeholder", "value", worth_searching(F.col("value")).alias("use"))).alias("entries"))
    names = pa.list_(pa.string())

    def run(text: pa.Array, found: pa.Array) -> pa.Array:
        done = [scrub_text(t or "", own) for t, own in zip(text.to_pylist(), rows.tuples(found))]
        plain = lambda k, kind: pa.array([d[k] for d in done], kind)
        return pa.StructArray.from_arrays([plain(0, pa.string()), rows.maps([d[1] for d in done], pa.int64()), *[plain(k, names) for k in (2, 3, 4)]], ["scrubbed", "occurrences", "not_found", "skipped", "residual"])

    kind = "struct<scrubbed:string,occurrences:map<string,bigint>,not_found:array<string>,skipped:array<string>,residual:array<string>>"
    return texts.join(gathered, id_col, "left").withColumn("r", rows.per_row(kind, run, F.col(text_col), F.col("entries"))).drop("entries").select("*", "r.*").drop("r")
