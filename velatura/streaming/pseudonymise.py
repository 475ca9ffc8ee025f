"""Pseudonymisation of streams. Numbers are per document, so the whole run is a map without state and takes late data as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velatura.operators.pseudonymise import analyse


def pseudonymised(stream: DataFrame, excluded: list[str] | None = None, reversible: bool = True) -> DataFrame:
    """A stream of documents (doc_id, text, ...) with the columns of analyse."""
    return analyse(stream, excluded, reversible)


def start(stream: DataFrame, out: str, checkpoint: str, dictionary_out: str | None = None) -> StreamingQuery:
    """Write pseudonymised texts, and dictionaries to a place of their own, batch by batch; a batch that is repeated after a loss
    overwrites its own folder, so each document is written once."""

    def batch(df: DataFrame, number: int) -> None:
        done = pseudonymised(df, reversible=dictionary_out is not None)
        done.select("doc_id", "anonymized_text", "n_entities", "n_unique").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if dictionary_out:
            rows = done.select("doc_id", F.explode("mapping").alias("placeholder", "value"))
            rows.write.mode("overwrite").parquet(f"{dictionary_out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time_col: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Entities by label and window of event time, with a watermark for late documents."""
    found = pseudonymised(stream, reversible=False).withWatermark(time_col, late)
    each = found.select(time_col, F.explode("by_label").alias("label", "n"))
    return each.groupBy(F.window(time_col, width), "label").agg(F.sum("n").alias("n"))
