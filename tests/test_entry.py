import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from velatura.functions import table
from velatura.operators import evaluate
from velatura.sources import writers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["detect_email_documents", "detect_url_pages", "detect_card_documents", "detect_cf_rendered", "detect_iban_grouped", "merge_spans", "merge_spans_arrow", "placeholders", "anonymize", "chunk_words", "tokenize", "bio_normalize", "dedup_exact", "length_profile", "generate_cf", "weighted_template", "stratified_quota", "latest_version", "lang_examples", "bio_remap", "generate_iban", "recogniser_union", "delimited_structure", "compare_pipelines", "wrong_documents", "index_and_reread", "by_length", "prf_by_label", "prf_overall", "restore_roundtrip", "dictionary_scrub", "simple_mask", "anonymize_irreversible", "anonymize_stats", "jsonl_roundtrip", "language_filter", "span_corpus_counts"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(repr([None if v is None or v != v else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in row]) for row in df.values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    got, exp = __spark_entry__.queries()[name](spark, SF).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns) and canonical(got) == canonical(exp)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_table_function_and_comparison(spark, tmp_path):
    table.register(spark)
    assert spark.sql("SELECT start_pos, value FROM detect_grouped_iban('x IT60 X054 2811 1010 0000 0123 456')").first().start_pos == 2
    spark.createDataFrame([(1, "a.b@c.it")], "doc_id long, text string").createOrReplaceTempView("texts")
    table.detections_view(spark, "texts", "found")
    assert spark.sql("SELECT label, value FROM found ORDER BY label").first().value == "a.b@c.it"
    docs = spark.createDataFrame([(1, "x", [1], [1]), (2, "x", [1], [2]), (3, "y", [], [])], "id int, category string, gold array<int>, pred array<int>").withColumn("all", F.col("gold"))
    scores, wrong = evaluate.compare_pipelines(docs, {"a": "pred", "b": "all"}, "id")
    assert {(r.pipeline, r.category): r.documents_exact for r in scores.collect()} == {("a", "x"): 1, ("a", "y"): 1, ("a", None): 2, ("b", "x"): 2, ("b", "y"): 1, ("b", None): 3}
    assert [(r.pipeline, r.id) for r in wrong.collect()] == [("a", 2)]
    writers.write_dictionary(spark.createDataFrame([(1, "[X_1]", "v")], "doc_id long, placeholder string, value string"), str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first().value == '{"[X_1]":"v"}'
