import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from velatura.llm import quality_rules
from velatura.llm.common import prepare


def test_forest_learns_from_every_labelled_row(spark):
    """The bad rows are those whose hashed ids come last, so that whoever learns from the first 20,000 never sees one."""
    words = "array('the','quick','brown','fox','jumps','over','a','lazy','dog','near','old','stone')"
    place = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    df = spark.range(22_000).withColumnRenamed("id", "doc_id").withColumn("quality", F.when(place > 21_000, 0).otherwise(1))
    mark = F.when(F.col("quality") == 0, "###").otherwise(F.expr("repeat('!', cast(doc_id % 3 as int))"))
    df = df.withColumn("text", F.concat(F.array_join(F.expr(f"transform({words}, (w, i) -> concat(w, repeat('e', cast((doc_id + i) % 4 as int))))"), " "), mark, mark))
    got = quality_rules.judge(df.select("doc_id", "text"), df.select("doc_id", "quality")).join(df, "doc_id").groupBy("quality", "kept").count().collect()
    assert sorted((r.quality, r.kept, r["count"]) for r in got) == [(0, False, 1_000), (1, True, 21_000)]


def brute_threshold(scores, good, good_loss):
    best = (0.0, float("inf"))
    for s in sorted(set(scores), reverse=True):
        lost, caught = ((scores >= s) & good).sum() / good.sum(), ((scores >= s) & ~good).sum() / (~good).sum()
        if lost <= good_loss and caught - 3 * lost > best[0]:
            best = (caught - 3 * lost, (s + max((x for x in scores if x < s), default=s)) / 2)
    return best[1]


@pytest.mark.parametrize("ranges", [1, 64, 1 << 14])
def test_threshold_equals_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(quality_rules, "SCORE_RANGES", ranges)
    prepare(spark)
    rng = np.random.default_rng(ranges)
    for good_loss, apart in ((0.005, 0.3), (0.05, 0.1), (0.2, 0.0), (0.0, 0.5)):
        good = rng.random(600) < 0.8
        scores = np.round(np.clip(rng.normal(0.4, 0.05, 600) + apart * ~good, 0, 1), 3)
        scored = spark.createDataFrame([(float(s), int(g)) for s, g in zip(scores, good)], "anomaly double, label long")
        assert quality_rules.threshold_of(scored, good_loss) == brute_threshold(scores, good, good_loss)
    assert quality_rules.threshold_of(scored.filter("label = 1")) == quality_rules.threshold_of(scored.limit(0)) == float("inf")


@pytest.mark.parametrize("parts", [1, 5])
def test_samples_and_box_are_of_all_rows(spark, parts):
    n = 6_000
    stats = [F.expr(f"pmod(xxhash64(id, {i}), 1000) + 1").alias(s) for i, s in enumerate(quality_rules.STATS)]
    found = spark.range(0, n, 1, parts).select(F.col("id").alias("doc_id"), F.expr("cast(id % 5 > 0 as long)").alias("label"), *stats)
    got = sorted(tuple(r) for r in found.collect())
    every = quality_rules.rates(np.array([r[2:] for r in got]))
    ids = np.array([r[0] for r in got if r[1]])
    points = every[[bool(r[1]) for r in got]]
    good, low, high = quality_rules._box(found)
    assert good == len(ids) and (low == every.min(0)).all() and (high == every.max(0)).all()
    drawn = quality_rules._samples(found, good)
    assert len(drawn) == quality_rules.TREES
    for t, own in enumerate(drawn):
        assert (own == points[np.argsort(quality_rules._draw(ids, t))[: quality_rules.SAMPLE]]).all()
    places = np.concatenate([np.argsort(quality_rules._draw(ids, t))[: quality_rules.SAMPLE] for t in range(quality_rules.TREES)])
    assert len(set(places.tolist())) == len(ids)
    few = quality_rules._samples(found.filter("doc_id < 20"), 16)
    assert all(sorted(map(tuple, own)) == sorted(map(tuple, points[:16])) for own in few)
