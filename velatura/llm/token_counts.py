"""Token counts of whole texts, by sentencepiece or tokenizers files, in Arrow functions that return lengths only.

Long texts divide at safe boundaries: a place before a space that follows another character. No piece of the vocabulary spans such
a place (this is looked up when the model is loaded; without it whole texts are encoded), so counts of parts add up to the
text's. The distinct parts of a batch go to the library in calls balanced by bytes, and counts of short ones are remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velatura.llm.common import prepare, rows, sliced

#: Characters of one call to the library.
CALL_CHARS = 1 << 16
#: Characters of a part up to which it is remembered, and bytes of all that a worker remembers, each part with ENTRY_BYTES of overhead.
SHORT_PART, ENTRY_BYTES = 128, 160
REMEMBERED_BYTES = 96 << 20
#: Characters that a model may take for a space or drop; texts that hold one are encoded whole.
_WHOLE = re.compile("[\\x00\u2581\u200b]")
_PART = re.compile(r" *[^ ]+(?: +\Z)?")


class Counter:
    """Numbers of tokens by one vocabulary file."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.held = 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            own = any(model.is_control(i) is False and model.is_unknown(i) is False and "▁" in p.lstrip("▁") for i, p in enumerate(pieces))
            self.safe = not own and model.encode(" a  b c", out_type=str)[:2] == ["▁", "▁a"]
            self.prefixed = True
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.lengths = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.safe = self.prefixed = False

    def balanced(self, texts: list[str]) -> Iterator[list[str]]:
        """The texts in calls of about CALL_CHARS each; a longer text is a call of its own."""
        call, size = [], 0
        for text in texts:
            if call and size + len(text) > CALL_CHARS:
                yield call
                call, size = [], 0
            call.append(text)
            size += len(text)
        if call:
            yield call

    def parts(self, text: str) -> list[str]:
        """Parts whose counts, each taken with the space that the library puts in front, add up to the text's."""
        if not self.safe or not text or _WHOLE.search(text):
            return [text]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        found = _PART.findall(text)
        return [found[0], *[p[1:] for p in found[1:]]] if found else [text]

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.parts(t) for t in texts]
        every = {p for parts in split for p in parts}
        missing = every.difference(self.known)
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held, missing = 0, every
        found = {}
        for call in self.balanced(list(missing)):
            found.update(zip(call, self.lengths(call)))
        short = {p: n for p, n in found.items() if len(p) <= SHORT_PART}
        self.known.update(short)
        self.held += sum(4 * len(p) if not p.isascii() else len(p) for p in short) + ENTRY_BYTES * len(short)
        if len(short) == len(found):
            get = self.known.__getitem__
            return [sum(map(get, parts)) for parts in split]
        return [sum(found[p] if p in found else self.known[p] for p in parts) for parts in split]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), over the whole text.

    Begin, end and added special tokens don't count; special strings inside texts are handled as the library does by default.

    Defined results: a null or empty text has no bytes and no tokens; repeated rows each get a row; a null id is kept; other
    columns are not looked at; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path).counts
        for batch in sliced(batches, 2):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            yield rows(schema, batch.column(0), batch.column(1), counts(texts))

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
