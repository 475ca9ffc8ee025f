"""Benchmark decontamination with suffix arrays of the training texts.

Each task turns a shard of whole documents into one sequence of word numbers, sorts the shard's suffixes (a suffix array,
compared over as many words as a window has), and binary-searches every test suffix in it. A range of equal prefixes gives all
places of a window; windows that follow each other in both texts join into the longest verbatim matches. Suffixes that hold a
word the benchmark lacks before the shortest window ends cannot match and are left out of the array.

The benchmark is the query set: it goes to the tasks in blocks of bounded bytes, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velatura.llm.common import blobs, cut, prepare, rows, sliced

#: Text bytes of a shard whose suffixes are sorted together, and of benchmark text sent to the tasks at once (some 100 bytes of
#: memory a word there).
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
#: Blocks that one plan searches; what they found is stored before the next ones.
PLAN_BLOCKS = 8
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return text.translate(_WORDS).split()


class Benchmark:
    """The test suffixes of some items: word numbers from 1, and each distinct window with the places it has in items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window, self.vocabulary = window, {}
        number = self.vocabulary.setdefault
        found = [(name, [number(w, len(self.vocabulary) + 1) for w in words_of(text)]) for name, text in items]
        found = [(name, ids) for name, ids in found if ids]
        self.names = [name for name, _ in found]
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = min(63 // self.bits, window)
        self.n_keys = -(-window // self.per_key)
        self.sizes = size = np.array([len(ids) for _, ids in found], np.int64)
        words = np.fromiter((x for _, ids in found for x in ids), np.int64, int(size.sum()))
        first, n = np.cumsum(size) - size, np.maximum(1, size - window + 1)
        item = np.repeat(np.arange(len(found)), n)
        word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        length, start = np.minimum(size, window)[item], first[item] + word
        padded = np.append(words, np.zeros(window, np.int64))
        columns = [np.where(length > j, padded[start + j], 0) for j in range(window)]
        low = strings(self.packed(np.stack(columns, axis=1)))
        _, one, which = np.unique(low, return_index=True, return_inverse=True)
        # A window's word numbers end in zeros where it is short, so equal strings are equal windows.
        top = (1 << self.bits) - 1
        high = np.stack([np.where(length[one] > j, c[one], top) for j, c in enumerate(columns)], axis=1)
        self.length, self.first, self.last = length[one], low[one], strings(self.packed(high))
        self.shortest = int(self.length.min()) if len(one) else 0
        order = np.argsort(which, kind="stable")
        self.place_start = np.searchsorted(which[order], np.arange(len(one) + 1))
        self.place_item, self.place_word = item[order], word[order]
        # Places of each window by the window before it in the item, and by the one after it; -1 at an item's ends.
        full = length == window
        before = np.where((word > 0) & full, np.concatenate([[-1], which[:-1]]) if len(which) else which, -1)
        after = np.where((word + 1 < n[item]) & full, np.append(which[1:], -1) if len(which) else which, -1)
        self.beside = [_by_neighbour(which, x, len(one)) for x in (before, after)]
        self.all_item, self.all_word = item, word

    def packed(self, words: np.ndarray) -> np.ndarray:
        """Fixed-width byte strings that sort as rows of word numbers do; words: one column for each word compared."""
        keys = np.zeros((len(words), self.n_keys), np.uint64)
        for k in range(self.n_keys):
            for j in range(self.per_key):
                w = k * self.per_key + j
                keys[:, k] <<= np.uint64(self.bits)
                if w < words.shape[1]:
                    keys[:, k] |= words[:, w].astype(np.uint64)
        return keys


def _by_neighbour(which: np.ndarray, neighbour: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of (window, neighbouring window), and these pairs as one number."""
    pair = which * (n + 1) + neighbour + 1
    order = np.argsort(pair, kind="stable")
    return order, pair[order]


def strings(keys: np.ndarray) -> np.ndarray:
    """Rows of unsigned numbers as byte strings of one width that end in a byte other than zero."""
    out = np.full((len(keys), keys.shape[1] * 8 + 1), 1, np.uint8)
    out[:, :-1] = keys.astype(">u8").view(np.uint8).reshape(len(keys), keys.shape[1] * 8)
    return out.view(f"S{out.shape[1]}").ravel()


def occurrences(sequence: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Every (position, window number) at which a window stands; sequence: word numbers, 0 for a foreign word or a text's end."""
    none = np.zeros(0, np.int64)
    if not bench.shortest or not len(sequence):
        return none, none
    n = len(sequence)
    breaks = np.flatnonzero(sequence == 0)
    run = np.append(breaks, n)[np.searchsorted(breaks, np.arange(n))] - np.arange(n)  # known words from here on
    starts = np.flatnonzero(run >= bench.shortest)
    if not len(starts):
        return none, none
    padded = np.concatenate([sequence, np.zeros(bench.window, sequence.dtype)])
    columns = np.stack([np.where(run[starts] > j, padded[starts + j], 0) for j in range(bench.window)], axis=1)
    keys = bench.packed(columns)
    order = np.lexsort(keys.T[::-1])
    array, suffixes = strings(keys[order]), starts[order]
    low, high = np.searchsorted(array, bench.first, "left"), np.searchsorted(array, bench.last, "right")
    found = np.flatnonzero(high > low)
    if not len(found):
        return none, none
    size = (high - low)[found]
    at = np.repeat(low[found] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return suffixes[at], np.repeat(found, size)


def _search(shared, shard_bytes: int, locate: bool):
    """In: key, text, and what earlier blocks found (spans flat, items). Out: the same with this block's finds, texts passed on."""
    schema = pa.schema([("row", pa.int64()), ("text", pa.binary()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])))])

    def shard(batch: pa.RecordBatch, bench: Benchmark) -> pa.RecordBatch:
        texts = blobs(batch, 1)
        get = bench.vocabulary.get
        parts, lengths = [], []
        for text in texts:
            words = words_of(text)
            parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            lengths.append(len(words))
        sequence = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + 1)])
        at, window = occurrences(sequence, bench)
        doc = np.searchsorted(starts, at, "right") - 1
        hits, items, matches = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
        order = np.lexsort((window, at))
        at, window, doc = at[order], window[order], doc[order]
        own, first = np.unique(doc, return_index=True)
        for d, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(doc)]):
            p, w = at[a:b] - starts[d], window[a:b]
            edge = np.zeros(lengths[d] + 1, np.int64)
            old = np.array(hits[d] or [], np.int64)
            np.add.at(edge, np.concatenate([p, old[::2]]), 1)
            np.add.at(edge, np.concatenate([p + bench.length[w], old[1::2]]), -1)
            turns = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])))
            hits[d] = turns.tolist()
            distinct = np.unique(w)
            named = np.unique(np.concatenate([bench.place_item[bench.place_start[x] : bench.place_start[x + 1]] for x in distinct.tolist()]))
            items[d] = sorted({*(items[d] or ()), *(bench.names[i] for i in named.tolist() if bench.names[i] is not None)})
            if locate:
                matches[d] = (matches[d] or []) + longest(p, w, bench)
        return rows(schema, batch.column(0), batch.column(1), np.array(lengths, np.int64), hits, items, matches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in sliced(batches, 1, shard_bytes):
            yield shard(batch, bench)

    return run, "row long, text binary, n_words long, hits array<int>, items array<string>, matches array<struct<item_id string, item_word int, doc_word int, n_words int>>"


def _ends(position: np.ndarray, window: np.ndarray, bench: Benchmark, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, item word, document word) of all places at which a match can't go on by `step` words, that is -1 or 1: pairs of a window's
    places in both texts whose neighbours are different windows. Pairs with equal neighbours are passed over as ranges."""
    full = bench.length[window] == bench.window
    beside = np.full(len(position), -1)
    of = np.flatnonzero(full)
    at = np.searchsorted(position[of], position[of] + step).clip(max=len(of) - 1) if len(of) else of
    beside[of] = np.where(position[of][at] == position[of] + step, window[of][at], -1)
    order, pair = bench.beside[step > 0]
    base = window * (len(bench.length) + 1)
    bounds = [np.searchsorted(pair, base, "left"), np.searchsorted(pair, base + beside + 1, "left"), np.searchsorted(pair, base + beside + 1, "right"), np.searchsorted(pair, base + len(bench.length), "right")]
    none = beside < 0  # nothing to pass over
    bounds[1], bounds[2] = np.where(none, bounds[3], bounds[1]), np.where(none, bounds[3], bounds[2])
    low, high = np.concatenate([bounds[0], bounds[2]]), np.concatenate([bounds[1], bounds[3]])
    n = high - low
    place = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return bench.all_item[place], bench.all_word[place], np.repeat(np.concatenate([position, position]), n)


def longest(position: np.ndarray, window: np.ndarray, bench: Benchmark) -> list[dict]:
    """Maximal verbatim matches in one document, from its windows sorted by position: the places where matches begin and those where they
    end, each in the order of diagonals of the two texts, belong together one by one. The work grows with the number of matches."""
    begin, end = (np.stack(_ends(position, window, bench, step)) for step in (-1, 1))
    begin, end = (x[:, np.lexsort((x[2], x[2] - x[1], x[0]))] for x in (begin, end))
    n_words = end[2] - begin[2] + np.minimum(bench.sizes[begin[0]], bench.window)
    return [{"item_id": bench.names[i], "item_word": j, "doc_word": p, "n_words": n} for i, j, p, n in zip(*begin.tolist(), n_words.tolist())]


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[Benchmark]:
    """The distinct items in blocks, each of about block_bytes at most; a single longer item is a block of its own."""
    items = cut(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).distinct())
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    n_blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    for k in range(n_blocks):
        yield Benchmark([(r.item, bytes(r.text or b"")) for r in items.filter(block == k).collect()], window)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", locate: bool = True, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For each document: doc_id, n_words, hits (spans of hit words as start, end, start, end ...), items (ids, sorted as
    strings), matches (longest verbatim matches: item_id, item_word, doc_word, n_words; only with locate) and contaminated.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.

    Defined results: a null or empty text has no words; a null item id marks words but isn't listed; repeated rows each get
    their result; an empty benchmark finds nothing; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    empty = lambda kind: F.lit(None).cast(kind)
    out = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"), empty("array<int>").alias("hits"), empty("array<string>").alias("items"), empty("array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>").alias("matches"))
    for k, bench in enumerate(benchmark_blocks(benchmark, window, block_bytes)):
        out = cut(out) if k and k % PLAN_BLOCKS == 0 else out
        out = out.mapInArrow(*_search(spark.sparkContext.broadcast(bench), shard_bytes, locate))
    hits = F.coalesce("hits", F.array().cast("array<int>"))
    return out.select(F.col("row").alias("doc_id"), "n_words", hits.alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "matches", (F.size(hits) > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs, unchanged and in full, in which no window occurs. Nulls, ties and extra columns as in find_leaks."""
    spark = docs.sparkSession
    prepare(spark)
    at, out = docs.columns.index(text_col), docs
    for k, bench in enumerate(benchmark_blocks(benchmark, window, block_bytes)):
        out = cut(out) if k and k % PLAN_BLOCKS == 0 else out
        shared = spark.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            get = bench.vocabulary.get
            for batch in sliced(batches, at, shard_bytes):
                parts, lengths = [], []
                for text in batch.column(at).to_pylist():
                    words = words_of((text or "").encode())
                    parts += [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), np.zeros(1, np.int32)]
                    lengths.append(len(words) + 1)
                found, _ = occurrences(np.concatenate(parts), bench)
                clean = np.ones(batch.num_rows, bool)
                clean[np.searchsorted(np.cumsum(lengths), found, "right")] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
    return out
