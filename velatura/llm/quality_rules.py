"""Quality rules: statistics of whole texts, judged by fixed limits and by an isolation forest over the statistics.

The forest (Liu, Ting and Zhou, 2008) splits small random samples at random values; what few splits set apart is anomalous. Each tree's
sample is drawn from all labelled rows, and the score above which a document counts as anomalous is calibrated on all of them as well:
ranges, draws and scores are worked out where the rows are, and the driver gets sums, the trees' samples and counts by score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velatura.llm.common import blobs, cut, prepare, rows, sliced

#: Trees, and rows in the sample of each, which the method fixes.
TREES, SAMPLE = 200, 256
#: Ranges of scores that are counted apart; the order inside one is worked out by a task.
SCORE_RANGES = 1 << 14
#: Largest share of rows labelled good that the threshold may turn away.
GOOD_LOSS = 0.005
SYMBOLS = b"#*$%&|<>"
_WINDOW = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_marks")
_NOT_START = bytes(c for c in range(128, 192))
_CAPITALS = bytes(range(65, 91))
_MARKS = b"!?"


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words that stand in a window of words found twice or more in the text, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key += (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))) * _MIX[j]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """STATS of a whole text. Words `[^\\x20\\x09-\\x0D]+`; characters are code points."""
    words = text.split()
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    without = lambda drop: len(text) - len(text.translate(None, drop))
    chars = sum(map(len, words)) - (0 if text.isascii() else without(_NOT_START))
    return (len(words), chars, without(SYMBOLS), len(filled) - len(set(filled)), repeated_words(words), len(lines), len(set(words)), without(_CAPITALS), without(_MARKS))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of each document, over the whole text; a null text has no words and one empty line."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((s, pa.int64()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = np.array([statistics(t) for t in blobs(batch, 1)], np.int64)
            yield rows(schema, batch.column(0), *found.T)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


def rates(stats: np.ndarray) -> np.ndarray:
    """Features of the forest: rates of the rules, which don't depend on a text's length.

    Shares of repeated lines and words are left to the base rules: as further features they make the forest worse on labels that it hasn't
    seen, since most good texts have none and a few have many (figures in the README).
    """
    s = dict(zip(STATS, stats.T.astype(np.float64)))
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([s["word_chars"] / words, s["n_symbols"] / words, s["n_capitals"] / chars, s["n_marks"] / words, s["n_distinct"] / words ** 0.9], axis=1)


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as flat arrays: the feature (-1 in a leaf), the value split at, the children, and a leaf's path length.

    Split values are drawn from the whole box of values that labelled rows have, so that a rate no usual document has is set
    apart by the first split on it, though all documents of the sample lie on one side. Where the points are too many to be passed,
    drawn holds the sample of each tree, and points one of them.
    """

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7, drawn: list[np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.usual = _usual_path(min(sample, max(len(points), 2)))
        depth = int(np.ceil(np.log2(max(2, min(sample, len(points))))))
        for t in range(trees):
            own = drawn[t] if drawn is not None else points[rng.choice(len(points), min(sample, len(points)), replace=False)] if len(points) else points
            nodes: list[list[float]] = []

            def grow(x: np.ndarray, level: int, low: np.ndarray, high: np.ndarray) -> int:
                at = len(nodes)
                nodes.append([-1, 0, 0, 0, level + _usual_path(len(x))])
                wide = np.flatnonzero(high > low) if len(x) else ()
                if level < 2 * depth and len(x) > 1 and len(wide):
                    f = int(rng.choice(wide))
                    value = rng.uniform(low[f], high[f])
                    left = x[:, f] < value
                    h2, l2 = high.copy(), low.copy()
                    h2[f] = l2[f] = value
                    nodes[at][:4] = [f, value, grow(x[left], level + 1, low, h2), grow(x[~left], level + 1, l2, high)]
                return at

            grow(own, 0, low, high)
            feature, value, a, b, path = np.array(nodes).T
            self.trees.append((feature.astype(np.int64), value, a.astype(np.int64), b.astype(np.int64), path))

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1; higher is odder."""
        total = np.zeros(len(points))
        for feature, value, a, b, path in self.trees:
            at = np.zeros(len(points), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(points[inner, feature[node]] < value[node], a[node], b[node])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.usual)


def threshold_of(scored: DataFrame, good_loss: float = GOOD_LOSS) -> float:
    """The score that parts the two labels best (a lost good row weighs three caught ones), of those that lose at most a share good_loss of the good rows.

    scored: anomaly (0 to 1) and label of every labelled row. Equal scores are counted together, ranges of scores are summed up on the driver,
    and each range is ordered by itself.
    """
    counted = cut(scored.groupBy("anomaly").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).withColumn("range", F.floor(F.col("anomaly") * SCORE_RANGES)))
    ranges = counted.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy(F.desc("range")).collect()
    good, bad = sum(r.good for r in ranges), sum(r.bad for r in ranges)
    if not good or not bad:
        return float("inf")
    above, lost, caught = [], 0, 0
    for r in ranges:
        if lost > good_loss * good:
            break
        above.append((r.range, lost, caught))
        lost, caught = lost + r.good, caught + r.bad
    above = scored.sparkSession.createDataFrame(above, "range long, lost long, caught long")
    down = Window.partitionBy("range").orderBy(F.desc("anomaly"))
    summed = counted.join(F.broadcast(above), "range").select(
        "anomaly", ((F.col("lost") + F.sum("good").over(down)) / F.lit(good)).alias("lost"), ((F.col("caught") + F.sum("bad").over(down)) / F.lit(bad)).alias("caught")
    )
    gains = summed.filter(F.col("lost") <= good_loss).withColumn("gain", F.col("caught") - 3 * F.col("lost")).filter("gain > 0")
    best = gains.orderBy(F.desc("gain"), F.desc("anomaly")).first()
    if best is None:
        return float("inf")
    below = counted.filter(F.col("anomaly") < best.anomaly).agg(F.max("anomaly")).first()[0]
    return (best.anomaly + (best.anomaly if below is None else below)) / 2


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return rates(np.stack([batch.column(s).to_numpy() for s in STATS], axis=1))


def _draw(ids: np.ndarray, tree: int) -> np.ndarray:
    """A number for each id that is as good as random, another for each tree, and different for different ids (splitmix64)."""
    x = ids.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _box(found: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows labelled 1, and the least and largest value of each rate among all rows."""
    schema = pa.schema([("good", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, low, high = 0, np.inf, -np.inf
        for batch in batches:
            if batch.num_rows:
                points = _points(batch)
                good, low, high = good + int(batch.column("label").to_numpy().sum()), np.minimum(low, points.min(0)), np.maximum(high, points.max(0))
        if np.ndim(low):
            yield rows(schema, [good], [low.tolist()], [high.tolist()])

    got = found.mapInArrow(run, "good long, low array<double>, high array<double>").collect()
    if not got:
        none = np.zeros(rates(np.zeros((0, len(STATS)))).shape[1])
        return 0, none, none
    return sum(r.good for r in got), np.min([r.low for r in got], axis=0), np.max([r.high for r in got], axis=0)


def _samples(found: DataFrame, good: int) -> list[np.ndarray]:
    """The sample of each tree: of all rows labelled 1, those SAMPLE that draw the smallest numbers.

    Only rows that draw a number below a bound for some tree are fetched; it is so chosen that twice as many are expected as are needed, and is
    doubled in the rare case that some tree has too few.
    """
    share = min(1.0, 2 * SAMPLE / max(good, 1))
    while True:
        bound = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))

        def run(batches: Iterator[pa.RecordBatch], bound: np.uint64 = bound) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, some = batch.column("doc_id").to_numpy(), np.zeros(batch.num_rows, bool)
                for t in range(TREES):
                    some |= _draw(ids, t) <= bound
                yield batch.filter(pa.array(some))

        table = found.filter("label = 1").mapInArrow(run, found.schema).toArrow().combine_chunks()
        if not table.num_rows:
            return [rates(np.zeros((0, len(STATS))))] * TREES
        ids, points = table.column("doc_id").to_numpy(), _points(table)
        drawn = [_draw(ids, t) for t in range(TREES)]
        if share == 1 or all((d <= bound).sum() >= SAMPLE for d in drawn):
            return [points[np.argsort(d)[:SAMPLE]] for d in drawn]
        share = min(1.0, 2 * share)


def _scored(df: DataFrame, forest: IsolationForest) -> DataFrame:
    """The columns of df, STATS among them, and anomaly."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("anomaly", pa.array(forest.scores(_points(batch))))

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", anomaly double")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> tuple[IsolationForest, float]:
    """The forest, grown on rows labelled 1 that pass the base rules, and its threshold, over rows of both labels that do: all of them."""
    clean = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
    chosen = clean.filter(F.col("label") == F.col("other")).select("doc_id", F.col("label").cast("long").alias("label"))
    # Both sides have each id once, so no task of the join can fill up with one id's rows.
    once = stats.filter(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s"))
    found = cut(once.join(chosen, "doc_id").select("doc_id", "label", "s.*"))
    good, low, high = _box(found)
    drawn = _samples(found, good)
    forest = IsolationForest(drawn[0], low, high, drawn=drawn)
    return forest, threshold_of(_scored(found, forest))


def judge(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, STATS, base_failed, anomaly (the forest's score) and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. kept: neither base_failed nor anomalous.

    Defined results: a null or empty text fails for want of words; repeated rows each get a row, and of labelled rows with one id the one
    of the smallest statistics is learnt from; without labels of both kinds nothing is anomalous; other columns are not looked at; an
    empty table gives no rows.
    """
    stats = cut(text_statistics(docs, id_col, text_col))
    forest, threshold = fit(stats, labels, label_col, id_col)
    return _scored(stats, forest).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))
