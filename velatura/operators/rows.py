"""What is done within one text, in plain Python and in time linear in the text and its spans (but for sorting), and the Arrow functions
that do it for whole batches. A span here is a tuple (label, start, end, score, validated, source, ord)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from velatura.functions.lineage import importable
from velatura.functions.spans import SPAN
from velatura.operators import iban
from velatura.operators.detect import DETECTORS, SOFT_LABELS, STRIDE

Span = tuple[str, int, int, float, bool, str, int]
Entity = tuple[str, int, int, str, str, str, bool, bool]

_DIGITS, _DOT, _MONEY, _WORD, _SPACES, _WORDS = re.compile(r"\d+"), re.compile(r"://|[A-Za-z0-9]\.[A-Za-z0-9]"), re.compile("€|eur", re.I), re.compile(r"\w*"), re.compile(r"\s+"), re.compile(r"\S+")
_DOC = re.compile(r"\bR\.?G|\bprot|\brep", re.I)
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}")
_COMPILED = {d.name: re.compile(d.source, re.I if d.fold else 0) for d in DETECTORS}


def _possible(text: str) -> dict[str, bool]:
    """Which detectors can match at all, from one scan for digits and a few cheap looks."""
    runs = [len(x) for x in _DIGITS.findall(text)]
    longest, total = max(runs, default=0), sum(runs)
    some = total > 0
    return {
        "email": "@" in text, "url": _DOT.search(text) is not None, "cf": longest >= 2, "cf_omocodic": True, "iban": longest >= 2, "card": total >= 13, "piva": longest >= 11, "phone": total >= 7, "amount": some and _MONEY.search(text) is not None,
        "plate": longest >= 3, "docid": some and _DOC.search(text) is not None, "date": total >= 6,
    }


def detect(text: str, detectors=DETECTORS, grouped_iban: bool = True) -> list[Span]:
    """All candidates of the rule net, as operators.detect finds them."""
    out: list[Span] = []
    if grouped_iban and _IBAN_HEAD.search(text):
        out += [("IBAN", a, b, 1.0, True, "regex", STRIDE + i) for i, (a, b) in enumerate(iban.find_grouped(text))]
    possible = _possible(text)
    for turn, d in enumerate(detectors, 2):
        if not possible[d.name]:
            continue
        i = turn * STRIDE
        for m in _COMPILED[d.name].finditer(text):
            value = m[0].rstrip(d.trim) if d.trim else m[0]
            if not value:
                continue
            ok = d.plain(value) if d.plain else False
            if ok or d.plain is None or not d.strict:
                out.append((d.label, m.start(), m.start() + len(value), 1.0 if ok else 0.9, ok, "regex", i))
            i += 1
    return out


def select(text: str, spans: Iterable[Span], soft: Sequence[str] = SOFT_LABELS) -> list[Span]:
    """Spans kept one by one in order of priority, if they touch none kept before, by marks on the text's places; in order of places."""
    spans = sorted(spans, key=lambda s: (not s[4], s[5] != "regex" or s[0] in soft, -s[3], s[1] - s[2], s[6]))
    taken, kept = bytearray(max((s[2] for s in spans), default=0)), []
    for s in spans:
        a, b = s[1], s[2]
        if a < b and taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            kept.append(s)
    return sorted(kept, key=lambda s: (s[1], s[6]))


def trim(text: str, spans: Iterable[Span]) -> list[Span]:
    """Without white space at both ends; what is only white space goes."""
    out = []
    for label, a, b, *rest in spans:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((label, a, b, *rest))
    return out


def widen(text: str, spans: Iterable[Span]) -> list[Span]:
    """An edge inside a word moves out to the word's end. Spans come in order, so a word is measured once for all its spans."""
    word = lambda c: c.isalnum() or c == "_"
    first, last = 0, 0  # the word measured last
    out = []
    for label, a, b, *rest in spans:
        if word(text[a]):
            if not first <= a < last:
                first, last = a, _WORD.match(text, a).end()
                while first > 0 and word(text[first - 1]):
                    first -= 1
            a = first
        if b < len(text) and word(text[b - 1]) and word(text[b]):
            if not first <= b < last:
                first, last = b - 1, _WORD.match(text, b).end()
                while first > 0 and word(text[first - 1]):
                    first -= 1
            b = last
        out.append((label, a, b, *rest))
    return out


def fuse(spans: Iterable[Span]) -> list[Span]:
    """In the order of places, longer ones first, ties as they come: a span that overlaps the one before it, or touches it under the same
    label, becomes part of it."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[1], -s[2])):
        o = out[-1] if out else None
        if o and (s[1] < o[2] or s[1] == o[2] and s[0] == o[0]):
            if s[2] > o[2]:
                out[-1] = (o[0], o[1], s[2], *o[3:])
        else:
            out.append(s)
    return out


def merge(text: str, spans: Iterable[Span], soft: Sequence[str] = SOFT_LABELS) -> list[Span]:
    return fuse(widen(text, trim(text, select(text, spans, soft))))


def folded(value: str) -> str:
    """The form under which values are the same: one space for each run of white space, none at the ends, case folded."""
    return " ".join(value.split()).casefold()


def number(text: str, spans: Iterable[Span]) -> list[Entity]:
    """(label, start, end, value, placeholder, source, validated, first): equal folded values of a label share [LABEL_k], numbered by first occurrence."""
    names: dict[tuple[str, str], str] = {}
    counts: Counter = Counter()
    out = []
    for label, a, b, _, ok, source, _ in spans:
        key = (label, folded(text[a:b]))
        new = key not in names
        if new:
            counts[label] += 1
            names[key] = f"[{label}_{counts[label]}]"
        out.append((label, a, b, text[a:b], names[key], source, ok, new))
    return out


def rewrite(text: str, entities: Sequence[Entity], reversible: bool = True) -> tuple[str, dict[str, str], list[tuple]]:
    """The text with placeholders, their first values (none if irreversible), and segments: literal texts and entities by turns."""
    pieces, segments, mapping, at = [], [], {}, 0
    for label, a, b, value, name, source, ok, first in entities:
        if a > at:
            pieces.append(text[at:a])
            segments.append((text[at:a], None, None, None, None))
        pieces.append(name)
        segments.append((value if reversible else None, label, name, source, ok))
        if first and reversible:
            mapping[name] = value
        at = b
    if at < len(text):
        pieces.append(text[at:])
        segments.append((text[at:], None, None, None, None))
    return "".join(pieces), mapping, segments


_NUMBERED, _NUMBER, _TAIL = re.compile(r"(.*?)(\d*)", re.S), re.compile(r"\d*"), re.compile(r"\s*\]?\**")


def _longest(names: dict[str, str], stem: str, digits: str) -> str | None:
    return next((n for k in range(min(len(digits), 20), -1, -1) if (n := stem + digits[:k]) in names), None)


def unwritten(text: str, segments: Iterable[tuple]) -> str | None:
    """The original of a text that still stands as rewrite left it: at each place its own value, whatever the rest of the text looks like. None for a
    text that has been changed since, or whose segments don't hold the values."""
    out, at = [], 0
    for t, _, name, _, _ in segments:
        now = t if name is None else name
        if t is None or not text.startswith(now, at):
            return None
        out.append(t)
        at += len(now)
    return "".join(out) if at == len(text) else None


def restore(text: str, mapping: dict[str, str]) -> str:
    """The text with every placeholder replaced by its value, in one pass. Brackets, spaces inside them and asterisks around them are optional, and
    there is no boundary on the right: of names that fit, the longest counts, so without its entry [X_12] reads as X_1 and a 2."""
    names = {k[1:-1]: v for k, v in mapping.items() if len(k) > 2}
    if not names:
        return text
    stems = sorted({_NUMBERED.fullmatch(n)[1] for n in names}, key=lambda s: (-len(s), s))
    head = re.compile("|".join(map(re.escape, stems)))
    out, done, at = [], 0, 0
    while m := head.search(text, at):
        begin = at = m.start()
        fitting = (_longest(names, s, _NUMBER.match(text, begin + len(s))[0]) for s in stems if text.startswith(s, begin))
        name = next(filter(None, fitting), None)
        if name is None:
            at += 1
            continue
        at = begin + len(name)
        while begin > done and text[begin - 1].isspace():
            begin -= 1
        if begin > done and text[begin - 1] == "[":
            begin -= 1
        while begin > done and text[begin - 1] == "*":
            begin -= 1
        out += [text[done:begin], names[name]]
        done = at = _TAIL.match(text, at).end()
    return "".join(out) + text[done:] if out else text


_TOKENS = re.compile(r"\w+|[^\w\s]")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end): words, and other characters one by one."""
    return [(m[0], m.start(), m.end()) for m in _TOKENS.finditer(text)]


def bio_labels(words: Sequence[tuple[str, int, int]], entities: Sequence[tuple[int, int, str]]) -> list[str]:
    """A label for each token: of the first entity (start, end, label) that holds it whole, beginning it if both start at one place."""
    out, starts = ["O"] * len(words), [a for _, a, _ in words]
    for a, b, label in reversed(entities):
        for i in range(bisect_left(starts, a), len(words)):
            if words[i][2] > b:
                break
            out[i] = ("B-" if words[i][1] == a else "I-") + label
    return out


def label_spans(labels: pa.ListArray) -> pa.ListArray:
    """Of lists of labels (O, B- and I- types), lists of struct<type, start, end> over token numbers: a type that changes ends a span, and an I- without
    one begins it. All lists of a batch at once."""
    offsets = labels.offsets.to_numpy()
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - first
    coded = labels.values.slice(first, n).dictionary_encode()
    known = [x if x is not None and x != "O" else None for x in coded.dictionary.to_pylist()]
    types = sorted({x[2:] for x in known if x is not None})
    number = {t: k for k, t in enumerate(types)}
    codes = coded.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)
    kind = np.array([-1 if x is None else number[x[2:]] for x in known] + [-1], np.int64)[codes]
    begins = np.array([x is not None and x.startswith("B-") for x in known] + [False], bool)[codes]
    head = np.zeros(n + 1, bool)  # the first token of a list
    head[offsets] = True
    before = np.concatenate(([-1], kind[:-1]))[:n]
    opens = (kind >= 0) & (begins | head[:n] | (before != kind))
    ends = (kind >= 0) & np.concatenate(((opens | (kind < 0))[1:], [True]))[:n] | (kind >= 0) & head[1:]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    values = pa.StructArray.from_arrays(
        [pa.DictionaryArray.from_arrays(pa.array(kind[starts], pa.int32()), pa.array(types, _TEXT)).cast(_TEXT), pa.array(starts - offsets[row], pa.int32()), pa.array(stops - offsets[row], pa.int32())], fields=list(_TYPED)
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets), pa.int32()), values)


def windows(text: str, words: int, shared: int) -> list[tuple[int, int, int]]:
    """(number, start, end) of windows of so many words, of which two share some; whole words only, the last one ending with the text's last word."""
    places = [m.span() for m in _WORDS.finditer(text)]
    step = max(1, words - shared)
    n = n_windows(len(places), words, shared)
    return [(k, places[k * step][0], places[min(k * step + words, len(places)) - 1][1]) for k in range(n)]


def n_windows(n_words: int, words: int, shared: int) -> int:
    return -(-max(n_words - words, 0) // max(1, words - shared)) + 1 if n_words else 0


# --- Arrow functions -------------------------------------------------------------------------------------------------------------
_TEXT = pa.string()
_SPAN = pa.struct([("label", _TEXT), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("validated", pa.bool_()), ("source", _TEXT), ("ord", pa.int32())])
_ENTITY = pa.struct([("label", _TEXT), ("start", pa.int32()), ("end", pa.int32()), ("value", _TEXT), ("placeholder", _TEXT), ("source", _TEXT), ("validated", pa.bool_()), ("first", pa.bool_())])
_SEGMENT = pa.struct([("t", _TEXT), ("label", _TEXT), ("ph", _TEXT), ("src", _TEXT), ("validated", pa.bool_())])
_PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_TYPED = pa.struct([("type", _TEXT), ("start", pa.int32()), ("end", pa.int32())])
ENTITY = "struct<label:string,start:int,end:int,value:string,placeholder:string,source:string,validated:boolean,first:boolean>"
SEGMENT = "struct<t:string,label:string,ph:string,src:string,validated:boolean>"
REWRITTEN = f"struct<anonymized_text:string,mapping:map<string,string>,segments:array<{SEGMENT}>>"
ANALYSED = (
    f"struct<entities:array<{ENTITY}>,anonymized_text:string,mapping:map<string,string>,segments:array<{SEGMENT}>,n_chunks:bigint,n_chars:bigint,n_entities:bigint,n_unique:bigint,"
    "by_label:map<string,bigint>,by_source:map<string,bigint>>"
)


def _offsets(lists: Sequence[Sequence]) -> pa.Array:
    at, out = 0, [0]
    for x in lists:
        at += len(x)
        out.append(at)
    return pa.array(out, pa.int32())


def structs(lists: Sequence[Sequence[tuple]], kind: pa.StructType) -> pa.ListArray:
    """Lists of tuples as a list array of structs, column by column."""
    columns = list(zip(*(t for own in lists for t in own))) or [()] * kind.num_fields
    return pa.ListArray.from_arrays(_offsets(lists), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))


def maps(each: Sequence[dict], value: pa.DataType) -> pa.MapArray:
    return pa.MapArray.from_arrays(_offsets(each), pa.array([k for m in each for k in m], _TEXT), pa.array([v for m in each for v in m.values()], value))


def tuples(array: pa.Array, names: Sequence[str] | None = None) -> list[list[tuple]]:
    """A list array of structs as lists of tuples, of all fields or of those named; null lists are empty."""
    values = array.flatten()
    flat = list(zip(*(c.to_pylist() for c in (values.flatten() if names is None else [values.field(n) for n in names]))))
    out, at = [], 0
    for n in array.value_lengths().fill_null(0).to_pylist():
        out.append(flat[at : at + n])
        at += n
    return out


def _texts(array: pa.Array) -> list[str]:
    return [t or "" for t in array.to_pylist()]


#: Bytes of a batch that are Python objects at once, unless a single row is longer.
SLICE_BYTES = 1 << 20


def sliced(run: Callable[..., pa.Array], columns: Sequence[pa.Array]) -> pa.Array:
    """run over slices of the columns that hold few bytes each. A batch comes as Arrow buffers; as Python objects, with what is made of them, it would
    take several times its size, and a worker keeps what it once took."""
    n = len(columns[0])
    size = lambda a, k: sum(c.slice(a, k).nbytes for c in columns)
    done, ahead = [], [(0, n)] if n else []
    while ahead:
        a, k = ahead.pop()
        if k > 1 and size(a, k) > SLICE_BYTES:
            ahead += [(a + k // 2, k - k // 2), (a, k // 2)]
        else:
            done.append(run(*(c.slice(a, k) for c in columns)))
    return pa.concat_arrays(done) if len(done) > 1 else done[0] if done else run(*columns)


def per_row(kind: str, run: Callable[..., pa.Array], *columns: Column) -> Column:
    """An Arrow function over the columns."""
    if session := SparkSession.getActiveSession():
        importable(session)

    def whole(*columns: pa.Array) -> pa.Array:
        return sliced(run, columns)

    return F.arrow_udf(whole, kind)(*columns)


def text_column(change: Callable[[str], str], text: Column) -> Column:
    """A function of each text; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else change(t) for t in texts.to_pylist()], _TEXT)

    return per_row("string", run, text)


_WINDOW = pa.struct([("chunk", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", _TEXT)])


def windows_column(text: Column, words: int, shared: int) -> Column:
    """array<struct<chunk, start, end, text>> of each text."""

    def run(texts: pa.Array) -> pa.Array:
        return structs([[(k, a, b, t[a:b]) for k, a, b in windows(t, words, shared)] for t in _texts(texts)], _WINDOW)

    return per_row("array<struct<chunk:int,start:int,end:int,text:string>>", run, text)


def bio_labels_column(text: Column, entities: Column) -> Column:
    """Labels of each text's tokens; entities: structs that have a label, a start and an end."""

    def one(text: str, entities: list[tuple]) -> list[str]:
        return bio_labels([("", *m.span()) for m in _TOKENS.finditer(text)], entities)

    def run(texts: pa.Array, every: pa.Array) -> pa.Array:
        found = [one(t, e) for t, e in zip(_texts(texts), tuples(every, ("start", "end", "label")))]
        return pa.ListArray.from_arrays(_offsets(found), pa.array([x for own in found for x in own], _TEXT))

    return per_row("array<string>", run, text, entities)


def word_spans_column(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of all matches in each text; a null text has none. The pattern is one of Python's."""
    rx = re.compile(pattern)

    def run(texts: pa.Array) -> pa.Array:
        found = [[m.span() for m in rx.finditer(t)] for t in _texts(texts)]
        return structs(found, _PLACE)

    return per_row("array<struct<start:int,end:int>>", run, text)


def span_labels(places: Sequence[tuple[int, int]], entities: Iterable[tuple[int, int, str]], table: dict[str, str]) -> list[str]:
    """As labels.bio_from_spans, for places in their order that don't overlap: each entity goes to its own tokens only."""
    out, starts = ["O"] * len(places), [a for a, _ in places]
    for a, b, label in entities:
        final = None if label is None or a is None or b is None else table.get(re.sub("_[^_]*$", "", label))
        if final is None:
            continue
        first = i = bisect_left(starts, a)
        while i < len(places) and places[i][1] <= b:
            out[i] = ("B-" if i == first else "I-") + final
            i += 1
    return out


def span_labels_column(places: Column, entities: Column, table: dict[str, str]) -> Column:
    """span_labels of each row; places and entities: structs that have a start and an end, and entities a label."""

    def run(own: pa.Array, every: pa.Array) -> pa.Array:
        found = [span_labels(p, e, table) for p, e in zip(tuples(own, ("start", "end")), tuples(every, ("start", "end", "label")))]
        return pa.ListArray.from_arrays(_offsets(found), pa.array([x for one in found for x in one], _TEXT))

    return per_row("array<string>", run, places, entities)


def label_spans_column(labels: Column) -> Column:
    """array<struct<type, start, end>> of each list of labels."""

    def run(every: pa.Array) -> pa.Array:
        return label_spans(every)

    return per_row("array<struct<type:string,start:int,end:int>>", run, labels)


_HIT = pa.struct([*_SPAN, ("value", _TEXT)])


def hits_column(text: Column, detectors=DETECTORS, grouped_iban: bool = True) -> Column:
    """Candidates of each text with their values."""

    def run(texts: pa.Array) -> pa.Array:
        return structs([[(*s, t[s[1] : s[2]]) for s in detect(t, detectors, grouped_iban)] for t in _texts(texts)], _HIT)

    return per_row(f"array<{SPAN[:-1]},value:string>>", run, text)


def detect_column(text: Column, detectors=DETECTORS, grouped_iban: bool = True) -> Column:
    """Candidates of each text. Unlike operators.detect, whose expressions hold lambdas, this can stand below a further Arrow function."""

    def run(texts: pa.Array) -> pa.Array:
        return structs([detect(t, detectors, grouped_iban) for t in _texts(texts)], _SPAN)

    return per_row(f"array<{SPAN}>", run, text)


def merge_column(text: Column, candidates: Column, soft: tuple[str, ...] = SOFT_LABELS) -> Column:
    def run(texts: pa.Array, every: pa.Array) -> pa.Array:
        return structs([merge(t, s, soft) for t, s in zip(_texts(texts), tuples(every))], _SPAN)

    return per_row(f"array<{SPAN}>", run, text, candidates)


def number_column(text: Column, spans: Column) -> Column:
    def run(texts: pa.Array, every: pa.Array) -> pa.Array:
        return structs([number(t, s) for t, s in zip(_texts(texts), tuples(every))], _ENTITY)

    return per_row(f"array<{ENTITY}>", run, text, spans)


def rewrite_column(text: Column, entities: Column, reversible: bool = True) -> Column:
    def run(texts: pa.Array, every: pa.Array) -> pa.Array:
        done, mapping, segments = zip(*(rewrite(t, e, reversible) for t, e in zip(_texts(texts), tuples(every)))) if len(texts) else ((), (), ())
        null = texts.is_null().to_pylist()
        return pa.StructArray.from_arrays([pa.array([None if n else d for d, n in zip(done, null)], _TEXT), maps(mapping, _TEXT), structs(segments, _SEGMENT)], ["anonymized_text", "mapping", "segments"])

    return per_row(REWRITTEN, run, text, entities)


def mask_column(text: Column, spans: Column) -> Column:
    """The text with each span as [LABEL]."""

    def one(t: str, spans: list[tuple]) -> str:
        ends = [0, *(s[2] for s in spans)]
        return "".join(f"{t[a:s[1]]}[{s[0]}]" for a, s in zip(ends, spans)) + t[ends[-1] :]

    def run(texts: pa.Array, every: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t, s) for t, s in zip(texts.to_pylist(), tuples(every))], _TEXT)

    return per_row("string", run, text, spans)


def restore_column(text: Column, mapping: Column, segments: Column | None = None) -> Column:
    """segments: those of the text's rewriting, which restore it exactly as long as nobody has changed it."""

    def one(t: str, m: list[tuple], own: list[tuple]) -> str:
        exact = unwritten(t, own)
        return restore(t, dict(m)) if exact is None else exact

    def run(texts: pa.Array, every: pa.Array, *given: pa.Array) -> pa.Array:
        raw = texts.to_pylist()
        return pa.array([None if t is None or m is None else one(t, m, own) for t, m, own in zip(raw, every.to_pylist(), tuples(given[0]) if given else [()] * len(raw))], _TEXT)

    return per_row("string", run, text, mapping, *([] if segments is None else [segments]))


def analyse_column(text: Column, model: Column | None, excluded: Sequence[str], reversible: bool, words: int, shared: int, soft: tuple[str, ...] = SOFT_LABELS) -> Column:
    """Detection, selection, numbering, rewriting and statistics of whole texts in one Arrow function. model: a recogniser's candidates."""
    unwanted = set(excluded)

    def run(texts: pa.Array, *given: pa.Array) -> pa.Array:
        found, done = [], []
        raw = texts.to_pylist()
        for t, own in zip(raw, tuples(given[0]) if given else [[]] * len(raw)):
            t = t or ""
            candidates = [*own, *detect(t)] if t else own
            if unwanted:
                candidates = [c for c in candidates if c[0] not in unwanted]
            entities = number(t, merge(t, candidates, soft)) if candidates else []
            found.append(entities)
            done.append(rewrite(t, entities, reversible))
        tally = lambda k: [Counter(e[k] for e in own) for own in found]
        columns = [
            structs(found, _ENTITY), pa.array([None if t is None else d[0] for t, d in zip(raw, done)], _TEXT), maps([d[1] for d in done], _TEXT), structs([d[2] for d in done], _SEGMENT), pa.array([n_windows(sum(1 for _ in _WORDS.finditer(t or "")), words, shared) for t in raw], pa.int64()),
            pa.array([None if t is None else len(t) for t in raw], pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([sum(e[7] for e in own) for own in found], pa.int64()), maps(tally(0), pa.int64()), maps(tally(5), pa.int64()),
        ]
        return pa.StructArray.from_arrays(columns, ["entities", "anonymized_text", "mapping", "segments", "n_chunks", "n_chars", "n_entities", "n_unique", "by_label", "by_source"])

    return per_row(ANALYSED, run, text, *([] if model is None else [model]))
