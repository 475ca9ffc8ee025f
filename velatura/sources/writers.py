"""Writers. Spark's commit protocol gives whole outputs or none; text keeps characters beyond ASCII as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_dictionary(dictionary: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """One JSON object of placeholders and values for each document."""
    one = dictionary.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("m"))
    one.select(F.to_json("m").alias("value")).write.text(path)


def write_metrics(scores: DataFrame, path: str) -> None:
    """Scores, some dozens of rows, as one JSON file and one table of text."""
    scores.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    wide = scores.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in scores.columns]).alias("value"))
    wide.coalesce(1).write.mode("overwrite").text(f"{path}/text")


def upsert(registry: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The registry with rows of the same key replaced, in the order of time."""
    return registry.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(order)


def _states(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole states of a registry, the oldest first. A state is whole once Spark's commit has marked it."""
    from velatura.sources.readers import existing

    if not existing(spark, [f"{path}/state-*/_SUCCESS"]):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state-*/_SUCCESS")
    return sorted(str(f.getPath().getParent()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def read_registry(spark: SparkSession, path: str) -> DataFrame | None:
    """The registry's last whole state; None if there is none yet."""
    states = _states(spark, path)
    return spark.read.json(states[-1]) if states else None


def write_registry(spark: SparkSession, path: str, new: DataFrame, key: str, order: str) -> None:
    """Replace the rows of equal keys in the registry at a path. The new state is written beside the last one, which counts until the commit and
    goes after it, so a crash at any time leaves a whole registry."""
    states, old = _states(spark, path), read_registry(spark, path)
    number = int(states[-1].rsplit("-", 1)[1]) + 1 if states else 0
    upsert(new.limit(0) if old is None else old, new, key, order).coalesce(1).write.mode("overwrite").json(f"{path}/state-{number:012d}")
    for state in states:
        folder = spark._jvm.org.apache.hadoop.fs.Path(state)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
