"""What a session needs: intermediate results that outlive lost executors, and workers that can import this package."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def checkpoint_folder(named: str | None, master: str) -> str:
    """The folder that spark.checkpoint.dir names; without it a folder of this machine in local mode, as in tests. On a cluster, where executors
    could not see such a folder, it is an error."""
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def ensure_folder(spark: SparkSession) -> None:
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master))


def reliable(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared checkpoint folder and read from there by all that follows."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)
