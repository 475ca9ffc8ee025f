"""Readers of labelled corpora, templates, dictionaries and documents, with explicit schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = T.ArrayType(T.StringType())
ENTITY = "array<struct<value:string,label:string,start:int,end:int>>"
PUBLIC_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("language", T.StringType()), ("source_text", T.StringType()), ("masked_text", T.StringType()), ("mbert_tokens", _WORDS), ("mbert_token_classes", _WORDS))])
EXAMPLE_SCHEMA = "source_text string, language string, template_id int, tokens array<string>, bio_labels array<string>, entities " + ENTITY + ", meta map<string,string>"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that there are, on whatever file system they lie; the others are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            found.append(p)
    return found


def usable(tokens: Column, labels: Column) -> Column:
    """Both arrays are there, not empty, and of one length."""
    return F.coalesce((F.size(tokens) > 0) & (F.size(tokens) == F.size(labels)), F.lit(False))


def read_public(spark: SparkSession, path: str, language: str | None = None, limit: int | None = None) -> DataFrame:
    """source_text, language ("?" if unknown), tokens, bio_labels of the public corpus's JSON lines; other rows are dropped."""
    df = spark.read.schema(PUBLIC_SCHEMA).json(path)
    df = df.select("source_text", F.coalesce(F.nullif("language", F.lit("")), F.lit("?")).alias("language"), F.col("mbert_tokens").alias("tokens"), F.col("mbert_token_classes").alias("bio_labels"))
    df = df.filter(usable(F.col("tokens"), F.col("bio_labels")))
    df = df.filter(F.col("language") == language) if language else df
    return df.limit(limit) if limit else df


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples from JSON lines; the language is "it" where it is missing; rows without usable arrays are dropped."""
    df = spark.read.schema(EXAMPLE_SCHEMA).json(path)
    return df.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("it"))).filter(usable(F.col("tokens"), F.col("bio_labels")))


def read_span_corpus(spark: SparkSession, path: str) -> DataFrame:
    """tokens and bio_labels of a Parquet corpus with unmasked_text and span_labels (spans written out as text)."""
    from velatura.operators.labels import bio_from_spans, decode_spans, token_spans

    df = spark.read.parquet(path).withColumn("spans", token_spans(F.col("unmasked_text"))).withColumn("entities", decode_spans(F.col("span_labels")))
    return df.select("unmasked_text", "entities", F.transform("spans", lambda s: s["value"]).alias("tokens"), bio_from_spans(F.col("spans"), F.col("entities")).alias("bio_labels"))


def span_corpus_counts(df: DataFrame) -> DataFrame:
    """type, kept, n: entities by final type, and those whose type is dropped."""
    from velatura.functions.taxonomy import SPAN_CORPUS, mapping

    base = F.regexp_replace(F.col("e.label"), "_[^_]*$", "")
    each = df.select(F.explode("entities").alias("e")).select(F.element_at(mapping(SPAN_CORPUS), base).alias("final"), base.alias("base"))
    return each.groupBy(F.coalesce("final", "base").alias("type"), F.col("final").isNotNull().alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """row_id, file and value of each line. The id is made of the file's name, the line's digest, and a number among equal lines of the file, so
    it doesn't depend on how files are split or in what order they are read; equal lines are interchangeable."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").withColumn("digest", F.sha2("value", 256))
    again = Window.partitionBy("file", "digest").orderBy(F.lit(0))
    return raw.withColumn("row_id", F.sha2(F.concat_ws("#", "file", "digest", (F.row_number().over(again)).cast("string")), 256)).select("row_id", "file", "value")


def index_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What a selection needs of each usable example of JSON lines files, without its tokens: row_id, file, language, tags. Missing files are
    left out."""
    from velatura.operators.labels import normalise, tags_of

    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], "row_id string, file string, language string, tags array<string>")
    parsed = _lines(spark, there).select("row_id", "file", F.from_json("value", "language string, tokens array<string>, bio_labels array<string>").alias("e")).select("row_id", "file", "e.*")
    parsed = parsed.filter(usable(F.col("tokens"), F.col("bio_labels")))
    return parsed.select("row_id", "file", F.coalesce(F.nullif("language", F.lit("")), F.lit("it")).alias("language"), tags_of(normalise(F.col("bio_labels"))).alias("tags"))


def reread(spark: SparkSession, paths: list[str], chosen: DataFrame) -> DataFrame:
    """The examples of the files whose row_id, as index_rows gives it, is among the chosen ones (a column row_id)."""
    lines = _lines(spark, existing(spark, paths)).join(chosen.select("row_id"), "row_id", "left_semi")
    return lines.select("row_id", F.from_json("value", EXAMPLE_SCHEMA).alias("e")).select("row_id", "e.*").withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.lit("it")))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """id, doc_type, text of a template bank (a JSON array), without templates that lack slots or hold unknown ones."""
    from velatura.operators.generate import SLOTS

    df = spark.read.schema("id int, doc_type string, text string").json(path, multiLine=True)
    slots = F.regexp_extract_all("text", F.lit(r"\{([\p{L}\p{N}_]+)\}"), 1)
    return df.filter((F.size(slots) > 0) & (F.size(F.array_except(slots, F.lit(list(SLOTS)))) == 0))


def is_pdf(path: Column, content: Column) -> Column:
    return F.lower(path).endswith(".pdf") | (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of text files: UTF-8 (with or without a mark), else UTF-16, else Latin-1. PDF files need a reader that isn't
    here and come with an error, as do other extensions."""
    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            for code in ("utf-8-sig", "utf-16"):
                try:
                    return b.decode(code)
                except UnicodeDecodeError:
                    pass
            return b.decode("latin-1")

        return content.map(one)

    df = spark.read.format("binaryFile").load(path).select("path", "content")
    ext = F.regexp_extract(F.lower("path"), r"(\.[^./]*)$", 1)
    error = F.when(is_pdf(F.col("path"), F.col("content")), "pdf").when(~ext.isin("", ".txt", ".md", ".csv", ".tsv"), "unsupported")
    return df.withColumn("error", error).select("path", F.when(F.col("error").isNull(), decoded("content")).alias("text"), "error")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """mapping (placeholder to value) of each JSON line."""
    return spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("mapping")).filter("mapping is not null")


def by_language(df: DataFrame, language: str) -> DataFrame:
    return df.filter(F.col("language") == language)
