"""What the operators of this subpackage share: session set-up, cutting lineage, joins with hot keys, and walking Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.functions.lineage import ensure_folder, importable

#: Text bytes that a Python worker holds at once, unless a single text is longer.
SLICE_BYTES = 4 << 20
#: A key that holds more than one in so many rows is hot, so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Rows up to which the right side of a join is broadcast whole.
FEW_ROWS = 1 << 17


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and make sure that there is a checkpoint folder.

    The folder is spark.checkpoint.dir where the cluster names one.
    """
    importable(spark)
    ensure_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored reliably in the shared checkpoint folder, so that lost executors cost no recomputation."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files, and checkpoints where it is told to, of frames that nothing refers to any more.

    Its cleaner learns of them when the driver's JVM collects garbage, which may not happen before the disk is full.
    """
    gc.collect()
    spark._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(left: DataFrame, right: DataFrame, key: str, n_col: str, total: int, how: str = "left") -> DataFrame:
    """A join of many rows with a side that has each key once, and in n_col how many rows on the left have the key.

    A short right side is broadcast whole. Of a longer one only hot keys are, each with over a thousandth of the `total` rows, so there are fewer
    than a thousand of them; all others shuffle, and none of those can fill a task.
    """
    right_rows = right.drop(n_col)
    if right.count() <= FEW_ROWS:
        return left.join(F.broadcast(right_rows), key, how)
    is_hot = F.col(n_col) * HOT_SHARE > total
    hot = right.filter(is_hot)
    names = F.broadcast(hot.select(key))
    return left.join(names, key, "left_semi").join(F.broadcast(hot.drop(n_col)), key, how).unionByName(left.join(names, key, "left_anti").join(right.filter(~is_hot).drop(n_col), key, how))


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where the bytes of a column reach the limit, so that work and memory are balanced by bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        if int(size.sum()) <= limit:
            yield batch
            continue
        part = (np.cumsum(size) - 1).clip(0) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def blobs(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """A binary column as bytes; null is empty."""
    return [x or b"" for x in batch.column(column).to_pylist()]


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, schema)], schema=schema)
