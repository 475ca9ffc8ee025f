"""Detection as SQL: a table function for one text at a time, and views for DataFrame users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """The table function detect_grouped_iban(text): start_pos, end_pos and value of each printed account number."""
    from velatura.operators.iban import find_grouped

    @F.udtf(returnType="start_pos int, end_pos int, value string")
    class DetectGroupedIban:
        def eval(self, text: str):
            for a, b in find_grouped(text or ""):
                yield a, b, text[a:b]

    spark.udtf.register("detect_grouped_iban", DetectGroupedIban)


def detections_view(spark: SparkSession, table: str, view: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """A temporary view of all candidates of a table's texts."""
    from velatura.operators.detect import detect_rows

    detect_rows(spark.table(table), id_col, text_col).createOrReplaceTempView(view)
