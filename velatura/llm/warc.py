"""A content-addressed archive of WARC records.

Payload bytes are stored once, under their SHA-256. Record headers are stored apart, byte by byte as they stand in the record,
with the address of the payload. Reading verifies every payload against its address and joins the two tables again. Records of
equal payloads are one response and revisits of it; a record's full bytes and its full payload can both be rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.llm.common import attach, cut, prepare, shared_folder

#: Fixed values of the WARC 1.0 format.
VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Records that read one copy of their payload.
COPY_RECORDS = 10_000
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _urn(*parts: Column) -> Column:
    """A record id of what tells a record from all others, as a URN."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def archive(pages: DataFrame, folder: str, min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write payloads (address, payload, copies) and headers (address, copy, header) of all pages to a folder.

    Of pages with equal payloads of at least min_bytes bytes, those with the largest id are responses and the others revisits of
    it; smaller payloads are all responses. The payload is the HTML in UTF-8. Only counts by address shuffle: of payloads that occur once
    the row itself is stored, of others that with the largest id. COPY_RECORDS headers read one copy of a payload, so that no
    payload gathers all its records in one task.

    Defined results: null HTML is an empty payload; repeated rows get a record each, of one type and with ids of their own; a null id is
    never the largest, and a group without any id is all responses; line ends in a URL are encoded, so that a header stays one
    line; other columns are not looked at; an empty table writes empty tables.
    """
    spark = pages.sparkSession
    prepare(spark)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    narrow = cut(pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("address"), F.octet_length(payload).cast("long").alias("n_bytes"),
        F.sha1(payload).alias("digest"), F.monotonically_increasing_id().alias("tie"),
    ))
    # Of equal payloads: the largest id, and the first of its rows.
    first = F.max(F.struct("page", (-F.col("tie")).alias("tie")))
    again = cut(narrow.groupBy("address").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("address", F.col("first.page").alias("keeper"), (-F.col("first.tie")).alias("keeper_tie"), "n"))
    total = narrow.count()
    stored = attach(pages.select(F.col(id_col).cast("long").alias("page"), F.sha2(payload, 256).alias("address"), payload.alias("payload")), again.withColumn("copies", F.ceil(F.col("n") / COPY_RECORDS).cast("int")), "address", "n", total)
    once = stored.filter(F.col("copies").isNull()).select("address", "payload", F.lit(1).alias("copies"))
    several = stored.filter(F.col("copies").isNotNull() & F.col("page").eqNullSafe(F.col("keeper"))).select("address", "payload", "copies").dropDuplicates(["address"])
    once.unionByName(several).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    joined = attach(narrow, again.withColumn("records", F.col("n")), "address", "n", total)
    revisit = F.col("keeper").isNotNull() & (F.col("n_bytes") >= min_bytes) & ~F.col("page").eqNullSafe(F.col("keeper"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    length = F.lit(len(HTTP_HEAD)) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _urn(F.col("address"), F.col("page"), F.col("tie"))),
        line("WARC-Target-URI", F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line("WARC-Page-ID", F.coalesce(F.col("page").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("address"), F.col("keeper"), F.col("keeper_tie"))), line("WARC-Refers-To-Page-ID", F.col("keeper").cast("string")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit(CRLF + HTTP_HEAD),
    )
    copy = F.pmod(F.col("tie"), F.coalesce(F.ceil(F.col("records") / COPY_RECORDS), F.lit(1))).cast("int")
    joined.select("address", copy.alias("copy"), header.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    """A field's value in the record header, null if it isn't there or empty. The URL, which a page can choose, has no line ends."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads, a row for each copy that headers read; one that doesn't have its address as SHA-256 fails the job."""
    found = spark.read.schema("address string, payload binary, copies int").parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its address "), "address")).cast("string")
    checked = found.select(F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(wrong).alias("address"), "payload", "copies")
    return checked.select("address", "payload", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: record (bytes, as in a WARC file) and payload (in full, for revisits as well; of responses it is null, as
    the record holds it). Headers and payloads are joined by address."""
    headers = spark.read.schema("address string, copy int, header string").parquet(f"{folder}/headers")
    revisit = _field("WARC-Type") == "revisit"
    record = F.concat(F.col("header").cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit((2 * CRLF).encode()))
    return headers.join(_stored(spark, folder), ["address", "copy"]).select(record.alias("record"), F.when(revisit, F.col("payload")).alias("payload"))


def parse_records(records: DataFrame) -> DataFrame:
    """A row for each record: page_id, record_type, refers_to, payload (full), payload_bytes and payload_digest (SHA-1, hex), all
    taken from the record's bytes; only a revisit's payload comes from beside it.

    A record whose length differs from its Content-Length, or whose payload from its digest, fails the job.
    """
    # The header is text; its bytes end at the first empty line.
    head = F.substring_index(F.col("record").cast("string"), 2 * CRLF, 1)
    cut_ = records.select("record", "payload", F.concat(head, F.lit(CRLF)).alias("header"), (F.octet_length(head) + 4).alias("at"))
    said = cut_.select("*", _field("Content-Length").cast("int").alias("size"))
    whole = (F.octet_length("record") == F.col("at") + F.col("size") + 4) & (F.substring(F.col("record"), F.col("at") + F.col("size") + 1, F.lit(4)) == F.lit((2 * CRLF).encode()))
    block = F.when(whole, F.substring(F.col("record"), F.col("at") + 1, F.col("size"))).otherwise(F.raise_error(F.lit("record differs from its Content-Length")).cast("binary"))
    parsed = said.select(
        _field("WARC-Page-ID").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"), _field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"), F.substring(_field("WARC-Payload-Digest"), 6, 40).alias("said"),
        F.when(_field("WARC-Type") == "revisit", F.col("payload")).otherwise(F.substring(block, F.lit(len(HTTP_HEAD) + 1), F.col("size") - len(HTTP_HEAD))).alias("payload"),
    ).select("*", F.sha1("payload").alias("found"))
    digest = F.when(F.col("said") == F.col("found"), F.col("found")).otherwise(F.raise_error(F.lit("payload digest differs from the record's")).cast("string"))
    return parsed.select("page_id", "record_type", "refers_to", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"))


def write_files(spark: SparkSession, folder: str, path: str) -> None:
    """The archive's records as WARC files, one for each partition, through Spark's own text writer."""
    text = read_records(spark, folder).select(F.decode("record", "UTF-8").alias("value"))
    # A record ends in a line feed, and the writer ends each row in one.
    text.select(F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files that write_files made, framed by their Content-Length: page_id, record_type, refers_to, block."""
    prepare(spark)
    schema = pa.schema([("header", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                at, headers, blocks = 0, [], []
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at) + 4
                    head = content[at:end]
                    n = int(head.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
                    headers.append(head.decode())
                    blocks.append(content[end : end + n])
                    at = end + n + 4
                    if sum(map(len, blocks)) > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(headers), pa.array(blocks, pa.binary())], schema=schema)
                        headers, blocks = [], []
                yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(blocks, pa.binary())], schema=schema)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, block binary")
    return found.select(_field("WARC-Page-ID").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"), _field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"), "block")


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return shared_folder(spark, "warc")
