"""Best-fit packing of token pieces into sequences, as hierarchical residual packing.

Tokens: a text divides before white space that follows something else; the byte-level tokenizer ends a pre-token at each such place,
so the parts' ids, one after the other, are the text's. Distinct short parts are encoded once and remembered, up to a number of bytes.

Packing: every task packs the pieces it has just made by best fit, largest first. Full or nearly full bins are final. The others
go on as items of their own length: groups of bounded size pack them again, in fewer and fewer groups, until one group has
them all or a round no longer gains anything. A bin's place is the sum of the places along its way.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velatura.llm.common import blobs, cut, prepare, rows, sliced

#: Items that one group packs.
GROUP_ITEMS = 1 << 16
#: Bytes of a part up to which it is remembered, and of all that a worker remembers: parts and ids, each with ENTRY_BYTES of overhead.
SHORT_PART, ENTRY_BYTES = 128, 180
REMEMBERED_BYTES = 96 << 20
#: Groups of one round that meet in one group of the next.
FAN_IN = 8
#: Characters that regular expression libraries may class differently; parts that hold one are encoded as they are.
_UNSURE = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]")
_PART = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Encoder:
    """Ids of whole texts by a byte-level BPE file of `tokenizers`, as little-endian unsigned 32-bit bytes.

    Pre-tokens are merged by tiktoken's core from the file's own vocabulary where that gives the same ids. It merges any two
    neighbours whose bytes together are an entry, `tokenizers` only the pair that made the entry. The results are equal for every input
    if ids follow the order of merges and each entry encodes to itself: bounds of an entry's bytes that stand while all
    earlier merges are done keep its inside as it is alone, so no other pair can be left there. This is looked up when the
    file is loaded; entries that don't encode to themselves are left out, and a file of another kind goes to `tokenizers`.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.pattern = regex.compile(PATTERN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self._core(json.loads(self.tokenizer.to_str()), PATTERN)

    def _core(self, spec: dict, pattern: str):
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            return None
        import tiktoken

        ids = [model["vocab"]["".join(m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(ids, ids[1:])) or model.get("unk_token") or model.get("dropout") or len(set(ids)) < len(ids):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        own = self.tokenizer.model.tokenize
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if i not in special and [x.id for x in own(token)] == [i]}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def parts(self, text: bytes) -> list[bytes]:
        """Parts of a text, each of white space followed by other characters; one space in front is most often all there is."""
        found = text.split(b" ")
        if len(found) == 1 or not self._plain(text):
            return _PART.findall(text)
        return [found[0], *[b" " + x for x in found[1:]]]

    @staticmethod
    def _plain(text: bytes) -> bool:
        return not (text.startswith((b" ", b"\n", b"\t", b"\r")) or text.endswith(b" ") or b"  " in text or b"\n " in text or b"\t " in text or b"\r " in text or b"\x0b " in text or b"\x0c " in text)

    def _ids(self, part: bytes) -> bytes:
        text = part.decode()
        if self.merge is None or _UNSURE.search(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        merge = self.merge
        return b"".join([array("I", merge(p.encode())).tobytes() for p in self.pattern.findall(text)])

    def _keep(self, part: bytes, ids: bytes) -> bytes:
        self.known[part] = ids
        self.held += len(part) + len(ids) + ENTRY_BYTES
        return ids

    def learn(self, part: bytes) -> bytes:
        """The ids of a part that isn't known; a short one is known from now on."""
        known = self.known
        if len(part) > SHORT_PART:
            return self._ids(part)
        # A run of these marks after a letter is a pre-token of its own.
        core = part.rstrip(b".,;:!?#*$%&|")
        if core != part and len(core) > 1 and core[-1:].isalpha() and b"<" not in core:
            marks = part[len(core) :]
            return self._keep(part, b"".join([known[x] if x in known else self._keep(x, self._ids(x)) for x in (core, marks)]))
        return self._keep(part, self._ids(part))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        known = self.known
        for text in texts:
            parts = self.parts(text) if text else []
            try:
                yield b"".join([known[p] for p in parts])
            except KeyError:
                if self.held > REMEMBERED_BYTES:
                    known.clear()
                    self.held = 0
                yield b"".join([known[p] if p in known else self.learn(p) for p in parts])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, kept with what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, place there, what each bin holds): largest first, each into the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    bin_of, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms = 0  # bit r: some bin has room r
    for i in order.tolist():
        size = int(sizes[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bin_of[i], place[i] = b, filled[b]
        filled[b] += size
        left = room - size
        if left:
            free[left].append(b)
            rooms |= 1 << left
    return bin_of, place, np.array(filled, np.int64)


def _pieces(path: str, end_id: int, capacity: int, nearly_full: int, group_items: int):
    """Documents to pieces, packed within the task. Bins are numbered by task and by order in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), ("filled", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path).encode
        first_bin = TaskContext.get().partitionId() << 32
        found: list[tuple[int, int, int, int, int]] = []

        def packed() -> pa.RecordBatch:
            nonlocal first_bin
            doc, piece, start, length, crc = zip(*found)
            bins, place, filled = best_fit(np.array(length, np.int64), capacity)
            out = rows(schema, doc, piece, start, length, crc, bins + first_bin, place, filled[bins])
            first_bin += len(filled)
            found.clear()
            return out

        for batch in sliced(batches, 1, 2 << 20):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(blobs(batch, 1))):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                found += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            if len(found) >= group_items:
                yield packed()
        if found:
            yield packed()

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, filled long"


def _repack(capacity: int):
    """A group's bins as items of a further round; a group is bounded by the caller. Each bin goes under its new bin's first member."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["filled", "bin"], ascending=[False, True], ignore_index=True)
        bins, place, filled = best_fit(group["filled"].to_numpy(), capacity)
        head = np.zeros(len(filled), np.int64)
        head[bins[::-1]] = group["bin"].to_numpy()[::-1]
        return pd.DataFrame({"bin": group["bin"], "into": head[bins], "place": place, "filled": filled[bins]})

    return run, "bin long, into long, place long, filled long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, slack: int = 2, id_col: str = "doc_id", text_col: str = "text", group_items: int = GROUP_ITEMS) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then end_id; one longer than the capacity is cut into pieces of the capacity, the first of
    which has what is left over. A bin with `slack` or fewer free places is final in the round that made it.

    Defined results: a null or empty text is one piece with only end_id; repeated rows are packed one by one; a null id is kept;
    other columns are not looked at; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    pieces = cut(source.mapInArrow(*_pieces(tokenizer_path, end_id, capacity, capacity - slack, group_items)))
    items = pieces.filter(F.col("filled") < capacity - slack).groupBy("bin").agg(F.max("filled").alias("filled"))
    items = cut(items)
    left, groups = items.count(), None
    moves: DataFrame | None = None
    while left > 1:
        least = -(-left // group_items)
        groups = least if groups is None else max(least, groups // FAN_IN, 1)
        if groups == least and moves is None:
            groups = max(least, min(left // 4096, least * FAN_IN)) or 1
        group = F.pmod(F.xxhash64("bin", F.lit(left)), F.lit(groups))
        round_ = cut(items.withColumn("group", group).groupBy("group").applyInPandas(*_repack(capacity)))
        step = round_.select("bin", "into", "place")
        if moves is None:
            moves = step
        else:  # where the bins of earlier rounds are now
            after = step.select(F.col("bin").alias("into"), F.col("into").alias("top"), F.col("place").alias("more"))
            moves = cut(moves.join(after, "into", "left").select("bin", F.coalesce("top", "into").alias("into"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
        items = cut(round_.filter((F.col("bin") == F.col("into")) & (F.col("filled") < capacity - slack)).select("bin", "filled"))
        was, left = left, items.count()
        if groups == 1 or groups == least and left > 0.98 * was:
            break
    if moves is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    moves = moves.select("bin", "into", F.col("place").alias("more"))
    return pieces.join(moves, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("offset"))
