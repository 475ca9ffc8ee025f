"""Personal data in whole texts: four patterns with exact checks, and a linear-chain conditional random field that adds spans.

The field tags tokens (runs without white space, without punctuation at their ends) by the shapes of the token and its neighbours,
so it finds values that the patterns run past: a phone number followed by an address, a card number followed by other digits,
numbers whose parts are set off by symbols. It is trained from a small labelled table by maximum likelihood, and decoded by
Viterbi over batches of equally long runs. Tokens of letters only are held to be outside; runs between them are all that needs
decoding, with the same best path. A tagged span must pass the check of its kind, and may not touch a span of the patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velatura.llm.common import prepare, rows, sliced

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE_LEFT, _EDGE_RIGHT = "\"'<[{|#*$%&,;:!?", "\"'>]}|#*$%&,;:!?."


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _valid(kind: str, value: str) -> bool:
    if kind == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d := digits(value)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits(value)) <= 15
    return _DOMAIN.search(value) is not None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns: leftmost, not overlapping within a kind; matches that fail their check are dropped."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            last = m.end()
            found.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(k, *m.span()) for m in pattern.finditer(text) if _valid(KINDS[k], m[0])]
    return found


#: Characters of a token up to which its shape is remembered, and symbols of a shape that are told one by one.
SHORT_TOKEN, LONG_SHAPE = 64, 64
_RUN = re.compile(r"[0-9]+|[A-Z]+|[^\W\d_]+|.", re.S)


def _symbols(core: str) -> list[str]:
    """Letters to a or A, digits to 9 with their number (up to three, 4, 5 to 12, 13 to 19, more), other characters as they are."""
    out = []
    for m in _RUN.finditer(core):
        s = m[0]
        if s[0].isascii() and s[0].isdigit():
            n = len(s)
            out.append("9" * n if n < 4 else "9{4}" if n == 4 else "9{5-12}" if n < 13 else "9{13-19}" if n < 20 else "9{+}")
        else:
            out.append("A" if s.isascii() and s.isupper() else "a" if s.isalpha() else s)
    return out


def _shape(core: str) -> str:
    found = _symbols(core)
    if len(found) <= LONG_SHAPE:
        return "".join(found)
    return "~" + "".join(sorted({x if x in ("a", "A") or x[0] == "9" or x.isascii() else "?" for x in found}))


_short_shape = lru_cache(1 << 16)(_shape)


def shape(core: str) -> str:
    """The shape of a whole token: its symbols in order; of a token with more than LONG_SHAPE of them, each that occurs, once."""
    return _short_shape(core) if len(core) <= SHORT_TOKEN else _shape(core)


def _coarse(s: str) -> str:
    return re.sub(r"9(\{[^}]*\})?", "9", re.sub(r"[aA]+", "a", s))


class Field:
    """The conditional random field. A token's features: its shape, the shape of runs, and the shapes of both neighbours."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(TAGS)))
        self.moves = np.zeros((len(TAGS) + 1, len(TAGS)))  # the last row: from a text's start
        self.parts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _names(place: str, s: str) -> list[str]:
        c = _coarse(s)
        return [f"{place}s={s}", f"{place}c={c}", f"{place}1={c[:1]}", f"{place}@={'@' in c}", f"{place}n={sum(x == '9' for x in s)}"]

    def fit(self, sentences: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.3, l2: float = 0.002) -> Field:
        """Maximise the likelihood of (shapes, tags) by gradient steps with momentum, all sentences at once."""
        longest, n, tags = max(len(s) for s, _ in sentences), len(sentences), {t: i for i, t in enumerate(TAGS)}
        per = 15
        feats, gold, mask = np.full((n, longest, per), -1), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, (shapes, own) in enumerate(sentences):
            around = ["", *shapes, ""]
            for t in range(len(shapes)):
                names = [x for d, p in ((-1, "<"), (0, "="), (1, ">")) for x in self._names(p, around[t + 1 + d])]
                feats[i, t] = [self.index.setdefault(x, len(self.index)) for x in names]
                gold[i, t], mask[i, t] = tags[own[t]], True
        self.weights = np.zeros((len(self.index) + 1, len(TAGS)))
        seen_f, seen_m = np.zeros_like(self.weights), np.zeros_like(self.moves)
        active = np.zeros((int(mask.sum()), len(self.weights)))  # the table is small, so its tokens by features is as well
        active[np.arange(len(active))[:, None], feats[mask]] = 1
        want = active.T @ np.eye(len(TAGS))[gold[mask]]
        e = np.zeros((n, longest, len(TAGS)))
        want_m = np.zeros_like(self.moves)
        for t in range(longest):
            np.add.at(want_m, (gold[mask[:, t], t - 1] if t else np.full(mask[:, t].sum(), len(TAGS)), gold[mask[:, t], t]), 1)
        size = mask.sum(1)
        for _ in range(steps):
            e[mask] = active @ self.weights
            move = self.moves[:-1]
            alpha = [self.moves[-1] + e[:, 0]]
            for t in range(1, longest):
                alpha.append(np.logaddexp.reduce(alpha[-1][:, :, None] + move, axis=1) + e[:, t])
            alpha = np.stack(alpha, 1)
            beta = np.zeros_like(alpha)
            for t in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(mask[:, t + 1, None], step, 0)
            total = np.logaddexp.reduce(alpha[np.arange(n), size - 1], axis=1)
            p = np.where(mask[:, :, None], np.exp(np.minimum(alpha + beta - total[:, None, None], 0)), 0)
            have = active.T @ p[mask]
            have_m = np.zeros_like(self.moves)
            have_m[-1] = p[:, 0].sum(0)
            for t in range(1, longest):
                joint = alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
                have_m[:-1] += np.where(mask[:, t, None, None], np.exp(np.minimum(joint, 0)), 0).sum(0)
            for w, seen, grad in ((self.weights, seen_f, (want - have) / n - l2 * self.weights), (self.moves, seen_m, (want_m - have_m) / n - l2 * self.moves)):
                seen *= 0.9
                seen += grad
                w += rate * seen
        self.weights[-1] = 0
        return self

    def emission(self, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a shape adds to the token after it, to its own token, and to the token before it."""
        if s not in self.parts:
            if len(self.parts) > 1 << 16:
                self.parts.clear()
            self.parts[s] = tuple(self.weights[[self.index.get(x, len(self.index)) for x in self._names(p, s)]].sum(0) for p in "<=>")
        return self.parts[s]

    def viterbi(self, runs: list[tuple[list[str], bool]]) -> list[np.ndarray]:
        """Best tags of each run, given as the shapes of its tokens between those of both neighbours; flag: the run starts a text."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i][0]))
        k = 0
        while k < len(order):
            length = len(runs[order[k]][0]) - 2
            same = k
            while same < len(order) and len(runs[order[same]][0]) - 2 == length and same - k < 4096:
                same += 1
            own = order[k:same]
            parts = [[self.emission(s) for s in runs[i][0]] for i in own]
            e = np.array([[p[t - 1][0] + p[t][1] + p[t + 1][2] for t in range(1, length + 1)] for p in parts])
            best = np.array([self.moves[-1] if runs[i][1] else self.moves[0] for i in own]) + e[:, 0]
            back = []
            for t in range(1, length):
                paths = best[:, :, None] + self.moves[:-1]
                back.append(paths.argmax(1))
                best = paths.max(1) + e[:, t]
            best = best + self.moves[:-1, 0]  # the neighbour after a run is outside
            tag = best.argmax(1)
            path = [tag]
            for b in reversed(back):
                tag = b[np.arange(len(own)), tag]
                path.append(tag)
            for i, tags in zip(own, np.stack(path[::-1], 1)):
                out[i] = tags
            k = same
        return out


def labelled_table(n: int = 400, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made by rule: (cores, tags) of short passages with values of each kind, alone or side by side, among
    plain words and numbers that are none (years, versions, prices, keys, ranges)."""
    rng = np.random.default_rng(seed)
    pick = lambda a, b: int(rng.integers(a, b))
    number = lambda k: "".join(str(pick(0, 10)) for _ in range(k))
    word = lambda: ("".join("etaoinshrdlu"[pick(0, 12)] for _ in range(pick(1, 9)))).capitalize() if pick(0, 6) == 0 else "".join("etaoinshrdlu"[pick(0, 12)] for _ in range(pick(1, 9)))
    of = {
        "email": lambda: [[f"{word()}.{number(2)}@{word()}{pick(0, 10)}.{word()}.com"], [f"{word()}@{word()}.org"], [f"{word()}_{word()}+{word()}@{word()}-{word()}.net"]][pick(0, 3)],
        "ip": lambda: [".".join(str(pick(0, 256)) for _ in range(4))],
        "card": lambda: [[number(16)], [number(4) for _ in range(4)], ["-".join(number(4) for _ in range(4))], [number(15)], [number(13)], [number(4), number(6), number(5)]][pick(0, 6)],
        "phone": lambda: [[f"+{pick(1, 10)}", f"({number(3)})", f"{number(3)}-{number(4)}"], [f"+{pick(10, 99)}", number(3), number(3), number(4)], [f"+{number(11)}"], [f"+{pick(1, 10)}-{number(3)}-{number(3)}-{number(4)}"], [f"+{pick(10, 99)}", f"{number(3)}.{number(3)}.{number(4)}"], [f"+{pick(1, 10)}", f"({number(3)})", number(3), number(4)]][pick(0, 6)],
        "none": lambda: [[str(pick(1900, 2100))], [f"{pick(0, 9)}.{pick(0, 9)}"], [f"{pick(0, 9)}.{pick(0, 20)}.{pick(0, 9)}"], [str(pick(0, 1000))], [f"{pick(1, 32)}/{pick(1, 13)}/{pick(1990, 2030)}"], [f"{pick(0, 99)}%"], ["".join("0123456789abcdef"[pick(0, 16)] for _ in range(40))], [f"{number(3)}-{number(4)}"], [f"({number(1)})"], [f"{word()}{pick(0, 10)}"], [f"@{word()}"], [f"{pick(10, 99)}-{pick(10, 99)}"]][pick(0, 12)],
    }
    kinds = [*KINDS, *KINDS, "none"]
    out = []
    for _ in range(n):
        tokens, tags = [word()] if pick(0, 4) else [], ["O"]
        tags = tags[: len(tokens)]
        for _ in range(pick(1, 4)):
            kind = kinds[pick(0, len(kinds))]
            value = of[kind]()
            tokens += value
            tags += ["O"] * len(value) if kind == "none" else [f"B-{kind}", *[f"I-{kind}"] * (len(value) - 1)]
            for _ in range(pick(0, 3)):
                tokens.append(word())
                tags.append("O")
        out.append((tokens, tags))
    return out


def train(table: list[tuple[list[str], list[str]]] | None = None) -> Field:
    """A field fitted to the labelled table (token cores and tags of each passage)."""
    return Field().fit([([shape(c) for c in cores], tags) for cores, tags in (labelled_table() if table is None else table) if cores])


def runs_of(text: str) -> Iterator[tuple[list[str], bool, list[tuple[int, int]]]]:
    """Runs of tokens that hold a digit or an @: the shapes with both neighbours', whether it starts the text, and the places.

    Tokens of symbols only stand for nothing and are passed over.
    """
    before, first, places, shapes = "", True, [], []
    for m in _TOKEN.finditer(text):
        raw, start = m[0], m.start()
        core = raw.lstrip(_EDGE_LEFT)
        start += len(raw) - len(core)
        core = core.rstrip(_EDGE_RIGHT)
        if not core:
            continue
        s = shape(core)
        if _TRIGGER.search(core):
            places.append((start, start + len(core)))
            shapes.append(s)
            continue
        if shapes:
            yield [before, *shapes, s], first, places
            shapes, places = [], []
        before, first = s, False
    if shapes:
        yield [before, *shapes, ""], first, places


def _values(kind: int, text: str, places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places of the valid values in tokens tagged as one: from each start the longest, then on after it, or after a start without any.

    A part of a text without a domain has none either, and an address of four numbers is one token, so that no other ends need trying
    for these kinds; numbers end where a further token's digits would be too many.
    """
    if KINDS[kind] == "email":
        places = [(places[0][0], places[-1][1])]
    if KINDS[kind] in ("email", "ip"):
        yield from ((a, b) for a, b in places if _valid(KINDS[kind], text[a:b]))
        return
    most = 19 if KINDS[kind] == "card" else 15
    held = [(a, b, n) for a, b in places if (n := len(digits(text[a:b])))]
    k = 0
    while k < len(held):
        stop, total = k, 0
        while stop < len(held) and (total := total + held[stop][2]) <= most:
            stop += 1
        last = next((j for j in range(stop - 1, k - 1, -1) if _valid(KINDS[kind], text[held[k][0] : held[j][1]])), None)
        if last is not None:
            yield held[k][0], held[last][1]
        k = k + 1 if last is None else last + 1


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(spans of the patterns, those with the field's added) of each text, sorted by kind and start."""
    base = [sorted(base_spans(t)) if _TRIGGER.search(t) else [] for t in texts]
    runs, owner = [], []
    for i, t in enumerate(texts):
        if _TRIGGER.search(t):
            for shapes, first, places in runs_of(t):
                runs.append((shapes, first))
                owner.append((i, places))
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, places), tags in zip(owner, field.viterbi(runs)):
        t = 0
        while t < len(tags):
            if tags[t] % 2 == 0:  # outside, or inside without a beginning
                t += 1
                continue
            kind, end = (int(tags[t]) - 1) // 2, t + 1
            while end < len(tags) and tags[end] == tags[t] + 1:
                end += 1
            added[i] += [(kind, a, b) for a, b in _values(kind, texts[i], places[t:end])]
            t = end
    out = []
    for own, more in zip(base, added):
        new = untouched(more, own) if own else more
        out.append((own, sorted([*own, *new]) if new else own))
    return out


def untouched(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that touch none of the others: these become disjoint stretches in order, of which each span looks up one."""
    starts, ends = [], []
    for _, a, b in sorted(others, key=lambda x: x[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [x for x in spans if (k := bisect_right(ends, x[1])) == len(ends) or starts[k] >= x[2]]


def find_personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base and spans (kind:start:end, by kind in
    the order of KINDS and start, comma-joined; code points, end exclusive; spans holds the field's as well).

    Defined results: a null or empty text has no spans; repeated rows each get a row; a null id is kept; other columns are not
    looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(train() if field is None else field)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]
    schema = pa.schema([(c, pa.int64()) for c in names[:5]] + [(c, pa.string()) for c in names[5:]])
    joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in sliced(batches, 1):
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], field)
            counts = [[sum(k == kind for k, _, _ in own) for own, _ in found] for kind in range(len(KINDS))]
            yield rows(schema, batch.column(0), *counts, [joined(own) for own, _ in found], [joined(every) for _, every in found])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ", ".join(f"{c} {'string' if c in ('base', 'spans') else 'long'}" for c in names))
