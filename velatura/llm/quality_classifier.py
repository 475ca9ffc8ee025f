"""Quality scores from a logistic regression on hashed word n-grams, trained by follow-the-regularised-leader (FTRL-proximal).

Tokens are runs of letters and digits, and runs of other characters than white space. A token that equals the one before it is
a ditto mark, so that repetition looks alike whatever is repeated. Features are the tokens and pairs of neighbours, hashed; a
feature's value is the square root of its share of all, so each text has length one. Scores are sparse dot products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velatura.llm.common import blobs, cut, prepare, rows, sliced

BITS = 20
#: At most so many labelled rows are trained on: those whose hashed ids are smallest, as long as their texts have so many bytes in all.
TRAIN_ROWS = 6000
TRAIN_BYTES = 64 << 20
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0d]+")
_DITTO = np.uint64(1)


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a whole text; an empty text has none."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    h = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    h[same] = _DITTO
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    one = h * np.uint64(0x9E3779B97F4A7C15)
    places, n = np.unique(np.concatenate([one, pair]) >> np.uint64(64 - bits), return_counts=True)
    return places.astype(np.int32), np.sqrt(n / (len(one) + len(pair))).astype(np.float32)


class Model:
    """FTRL-proximal state: per-coordinate learning rates, L1 keeps rare features out."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        at, x = np.append(places, len(self.z) - 1), np.append(values, np.float32(1))
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g

    def frozen(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def score(weights: np.ndarray, text: bytes, bits: int = BITS) -> float:
    places, values = features(text, bits)
    return float(1 / (1 + np.exp(-np.clip(np.dot(weights[places], values) + weights[-1], -30, 30))))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows that are never trained on: crc32 of the id as text is divisible by 5."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, epochs: int = 4, bits: int = BITS) -> np.ndarray:
    """Weights, with the intercept last. Learns from at most train_rows labelled rows that aren't held out, on whole texts of at most
    train_bytes bytes in all.

    Both classes weigh alike in sum. Labels other than 0 and 1, null ids and ids that occur twice with different labels are left
    out; of rows with one id the one of the smallest text counts; without any label, or with one class only, all weights are zero
    and each score is a half.
    """
    prepare(docs.sparkSession)
    clean = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
    chosen = clean.filter((F.col("label") == F.col("other")) & ~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(train_rows).select("id", "label")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            found = [features(t, bits) for t in blobs(batch, 2)]
            yield rows(schema, batch.column(0), batch.column(1), [p for p, _ in found], [v for _, v in found])

    # The chosen rows are at most train_rows pairs of numbers, so their broadcast is bounded.
    picked = cut(texts.join(F.broadcast(chosen), "id").groupBy("id", F.col("label").cast("int").alias("label")).agg(F.min(F.coalesce("text", F.lit(b""))).alias("text")))
    before = Window.orderBy(F.xxhash64("id"), "id")  # over train_rows rows at most
    fits = picked.select("id", F.sum(F.octet_length("text")).over(before).alias("n")).filter(F.col("n") <= train_bytes).select("id")
    got = picked.join(F.broadcast(fits), "id", "left_semi").mapInArrow(run, "id long, label int, places array<int>, values array<float>").toArrow()
    label = got.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return np.zeros((1 << bits) + 1, np.float32)
    ids = got.column("id").to_numpy()
    places, values = got.column("places").combine_chunks(), got.column("values").combine_chunks()
    start, flat_p, flat_v = places.offsets.to_numpy(), places.values.to_numpy(), values.values.to_numpy()
    model, share = Model(bits), np.bincount(label, minlength=2) / len(label)
    order = np.lexsort((ids, np.array([crc32(str(i).encode()) for i in ids.tolist()])))
    for _ in range(epochs):
        for i in order.tolist():
            part = slice(start[i], start[i + 1])
            model.learn(flat_p[part], flat_v[part], int(label[i]), 0.5 / share[label[i]])
    return model.frozen()


def quality_scores(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """For each document: doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Defined results: a null or empty text has the score of the intercept; repeated rows each get a row; a null id isn't held out;
    other columns are never looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in sliced(batches, 2):
            yield rows(schema, batch.column(0), batch.column(1), [score(w, t, bits) for t in blobs(batch, 2)])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of docs, unchanged, that score at least the threshold.

    Defined results: null and empty texts have the score of the intercept; repeated rows are judged one by one; ids are not looked at; columns
    of any name and type pass through; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared, at = spark.sparkContext.broadcast(weights), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in sliced(batches, at):
            yield batch.filter(pa.array([score(w, (t or "").encode(), bits) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
