"""Removal of lines that many documents share, with two Bloom filters in front of the exact count.

1. Every task hashes the distinct keys of its documents into two filters, for hashes seen once and seen twice (and tells what it sees a
   third time). What leaves the task are the places of the filters' bits. Merged, they tell which bits are seen a third time or more; a key
   that three documents hold has no other bits, and false positives only add suspects.
2. That filter of suspects, of a fixed size, goes to all tasks. Only the keys that it knows shuffle, as whole strings, for the exact
   number of documents and the largest id of each.
3. The confirmed keys go to the documents: as a broadcast map behind a check of its bytes, by a join beyond it.

Past the amount of text whose lines filters of the fixed size hold well, each range of hashes has filters of its own in the task that owns the
range: hashes travel to it (eight bytes a line), and what it finds suspect fills the filter of step 2. Both ways confirm the same keys.

A key is a line without `[\\x20\\x09-\\x0D]` at both ends, with A-Z in lower case.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from velatura.llm.common import blobs, cut, fresh, prepare, rows, sliced

#: Bytes of text for each bit of a filter, from least to most bits. Past FULL times as much text, filters go by ranges of hashes.
BYTES_A_BIT, FULL = 32, 4
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30
#: Bits of each filter of a range of hashes. More hashes than a filter holds well only mean more suspects.
RANGE_BITS = 1 << 25
PROBES = 4
#: Most parts that a filter is merged in.
PARTS = 64
#: Largest number of bytes of confirmed keys that is broadcast; beyond it a join is used.
BROADCAST_BYTES = 32 << 20
#: Hashes that a task gathers before it sums and sends them.
FLUSH = 1 << 18


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line; None where it is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        if len(line) < min_chars:
            out.append(None)
            continue
        key = line.strip().lower()
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode(errors="replace")) >= min_chars
        out.append(key if long else None)
    return out


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _hashes(text: bytes, min_chars: int) -> list[int]:
    """Hashes of a text's distinct keys."""
    return [_hash(k) for k in set(keys_of(text, min_chars)) if k is not None] if len(text) >= min_chars else []


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash in a filter, one row for each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


class BloomPair:
    """Filters of one task for hashes seen once and seen twice."""

    def __init__(self, bits: int = RANGE_BITS):
        self.bits = bits
        self.once, self.twice = np.zeros(bits, bool), np.zeros(bits, bool)

    def third(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Take in distinct hashes, each seen so many times more; those seen three times or more by now (or, rarely, fewer)."""
        at = places(hashes, self.bits)
        seen = times + self.once[at].all(axis=1) + self.twice[at].all(axis=1)
        self.once[at] = True
        self.twice[at[seen >= 2]] = True
        return hashes[seen >= 3]


def _packed(at: np.ndarray) -> bytes:
    """Sorted numbers as compressed bytes of their differences."""
    return zlib.compress(np.ascontiguousarray(np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(held: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(held), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def _filters(bits: int, hashes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """A task's filters: of each part, the places of the bits of all hashes, of those seen twice, and of those seen a third time."""
    schema = pa.schema([("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary()), ("more", pa.binary())])
    parts = parts_of(bits)
    size = bits // parts
    every = [np.unique(places(hashes[times >= n], bits)) for n in (1, 2, 3)]
    edges = [np.searchsorted(at, np.arange(parts + 1) * size) for at in every]
    own = [i for i in range(parts) if edges[0][i] < edges[0][i + 1]]
    return rows(schema, own, *([_packed(at[e[i] : e[i + 1]] - i * size) for i in own] for at, e in zip(every, edges)))


def parts_of(bits: int) -> int:
    return min(PARTS, bits // 8)


_FILTERS = "part int, once binary, twice binary, more binary"


def _sightings(min_chars: int, bits: int | None):
    """Each task's filters, if their bits are given; otherwise its hashes, summed before they shuffle."""
    schema = pa.schema([("hash", pa.int64()), ("times", pa.int32())])

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        hashes, times = np.unique(np.concatenate(parts), return_counts=True)
        return rows(schema, hashes.view(np.int64), np.minimum(times, 3).astype(np.int32)) if bits is None else _filters(bits, hashes, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in sliced(batches, 0):
            for text in blobs(batch, 0):
                if found := _hashes(text, min_chars):
                    parts.append(np.array(found, np.uint64))
                    n += len(found)
            if n >= FLUSH:
                yield summed(parts)
                parts, n = [], 0
        if parts:
            yield summed(parts)

    return run, "hash long, times int" if bits is None else _FILTERS


def _owned(range_bits: int, bits: int):
    """Hashes that a task owns, past its two filters; the suspects among them as a filter of the common size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, found = BloomPair(range_bits), [np.zeros(0, np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, at = np.unique(batch.column(0).to_numpy().view(np.uint64), return_inverse=True)
            times = np.bincount(at, weights=batch.column(1).to_numpy(), minlength=len(hashes)).astype(np.int64)
            found.append(pair.third(hashes, np.minimum(times, 3)))
        suspects = np.unique(np.concatenate(found))
        for i in range(0, len(suspects), FLUSH):
            part = suspects[i : i + FLUSH]
            yield _filters(bits, part, np.full(len(part), 3))

    return run, _FILTERS


def _merged(bits: int):
    """Filters of one part each, sorted by part, to the part's filter of bits seen a third time or more."""
    schema, size = pa.schema([("part", pa.int32()), ("bits", pa.binary())]), bits // parts_of(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = None, np.zeros(size, np.uint8)
        for batch in batches:
            for own, *lists in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part and part is not None:
                    yield rows(schema, [part], [np.packbits(seen >= 3).tobytes()])
                    seen[:] = 0
                part = own
                for held in lists:
                    at = _unpacked(held)
                    seen[at] = np.minimum(seen[at] + 1, 3)
        if part is not None:
            yield rows(schema, [part], [np.packbits(seen >= 3).tobytes()])

    return run, "part int, bits binary"


def _candidates(min_chars: int, known, bits: int):
    """(doc_id, key) of each distinct key of each row that the filter knows."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(known.value, np.uint8)
        for batch in sliced(batches, 1):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), blobs(batch, 1)):
                own = [k for k in set(keys_of(text, min_chars)) if k is not None] if len(text) >= min_chars else []
                keys += own
                ids += [doc_id] * len(own)
            at = places(np.fromiter(map(_hash, keys), np.uint64, len(keys)), bits)
            hit = np.flatnonzero((seen[at >> 3] & (128 >> (at & 7)).astype(np.uint8)).astype(bool).all(axis=1)).tolist()
            yield rows(schema, [ids[i] for i in hit], [keys[i] for i in hit])

    return run, "doc_id long, key binary"


def _keep(out_schema: pa.Schema, text_at: int, min_chars: int, known, n_chars_at: int | None, extra: bool):
    """Drop lines. The keys to drop stand in the broadcast map key -> keeper, with the row's id in the last column; or else in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = known.value if known is not None else None
        for batch in sliced(batches, text_at):
            texts, last = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out, n_lines, n_dropped = [], [], []
            for text, own in zip(texts, last):
                raw = (text or "").encode()
                lines = raw.split(b"\n")
                if keepers is not None:
                    kept = [line for line, key in zip(lines, keys_of(raw, min_chars)) if key is None or keepers.get(key, own) == own] if len(raw) >= min_chars else lines
                else:
                    drop = set(own or ())
                    kept = [line for line, key in zip(lines, keys_of(raw, min_chars)) if key not in drop] if drop else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                out.append(text if len(kept) == len(lines) else b"\n".join(kept).decode())
            columns = [batch.column(k) for k in range(len(out_schema) - 2 * extra)]
            columns[text_at] = pa.array(out, pa.string())
            if n_chars_at is not None:
                changed = [None if (n := old) is None and not d else len(t or "") if d else n for old, d, t in zip(batch.column(n_chars_at).to_pylist(), n_dropped, out)]
                columns[n_chars_at] = pa.array(changed, out_schema.field(n_chars_at).type)
            yield rows(out_schema, *columns, *([n_lines, n_dropped] if extra else []))

    return run


def suspects(text: DataFrame, min_chars: int, most_bits: int = MOST_BITS, range_bits: int = RANGE_BITS) -> tuple[bytes, int]:
    """The merged filter of keys (of the binary column text) that may be in three rows or more, and its number of bits."""
    want = -(-(text.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 1) // BYTES_A_BIT)
    bits = min(most_bits, max(LEAST_BITS, 1 << (want - 1).bit_length()))
    if want <= FULL * bits:
        sent = text.mapInArrow(*_sightings(min_chars, bits))
    else:
        sent = text.mapInArrow(*_sightings(min_chars, None)).repartition("hash").mapInArrow(*_owned(range_bits, bits))
    parts = sent.repartition(parts_of(bits), "part").sortWithinPartitions("part").mapInArrow(*_merged(bits)).collect()  # bits / 8 bytes in all
    merged = np.zeros(bits // 8, np.uint8)
    for r in parts:
        size = len(r.bits)
        merged[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return merged.tobytes(), bits


def confirmed_keys(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS, range_bits: int = RANGE_BITS) -> tuple[DataFrame, DataFrame]:
    """(key, keeper) of every key in at least min_docs documents, and the (doc_id, key) rows that they were counted from."""
    if min_docs < 3:
        raise ValueError("the filters find keys seen three times or more; min_docs must be at least 3")
    spark = docs.sparkSession
    prepare(spark)
    known, bits = suspects(docs.select(F.col(text_col).cast("binary").alias("text")), min_chars, most_bits, range_bits)
    text = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = cut(text.mapInArrow(*_candidates(min_chars, spark.sparkContext.broadcast(known), bits)))
    counted = found.groupBy("key").agg(F.countDistinct(F.struct("doc_id")).alias("n_docs"), F.max("doc_id").alias("keeper"))
    return cut(counted.filter(F.col("n_docs") >= min_docs).select("key", "keeper")), found


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, most_bits: int = MOST_BITS, range_bits: int = RANGE_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with their texts after the drop; with counts, also n_lines (before) and n_dropped.

    Keys of at least min_chars code points found in at least min_docs documents (different ids) lose all their lines, except in
    the largest id that holds them, where all stay. A column n_chars, if there is one, follows each changed text.

    Defined results: a null text stays null and has one empty line; ids are compared as 64-bit numbers, whatever their type (a text that
    isn't a number is a null id); rows of one id count as one document; a null id counts as a document, is never the largest,
    and loses its lines; columns of other names and types pass through; an empty table gives none.
    """
    spark = docs.sparkSession
    confirmed, found = confirmed_keys(docs, min_chars, min_docs, id_col, text_col, most_bits, range_bits)
    size = confirmed.agg(F.sum(F.length("key") + 64).alias("bytes")).first().bytes or 0
    columns = docs.columns
    out = T.StructType(docs.schema.fields + ([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if counts else []))
    own = docs.withColumn(fresh("own_id", docs), F.col(id_col).try_cast("long"))
    at = dict(text_at=columns.index(text_col), min_chars=min_chars, n_chars_at=columns.index("n_chars") if "n_chars" in columns else None, extra=counts)
    if size <= broadcast_bytes:
        known = spark.sparkContext.broadcast({bytes(r.key): r.keeper for r in confirmed.collect()})
        return own.mapInArrow(_keep(to_arrow_schema(out), known=known, **at), out)
    lost = found.distinct().join(confirmed, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # A document's own keys, so no list is longer than its text.
    lost_id, lost_keys = fresh("lost_id", own), fresh("lost_keys", own)
    lost = lost.groupBy(F.col("doc_id").alias(lost_id)).agg(F.collect_list("key").alias(lost_keys))
    joined = own.join(lost, F.col(own.columns[-1]).eqNullSafe(F.col(lost_id)), "left").select(*columns, lost_keys)
    return joined.mapInArrow(_keep(to_arrow_schema(out), known=None, **at), out)
