"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velatura.llm.common import cut, remove, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velatura.llm.decontaminate import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    spans = F.transform(F.filter("hits", lambda _, i: i % 2 == 0), lambda a, i: F.element_at("hits", 2 * i + 2) - a)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, n: s + n)
    longest = F.array_max(F.transform("matches", lambda m: m["n_words"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.coalesce(longest, F.lit(0)).cast("long").alias("longest_match"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velatura.llm.quality_rules import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velatura.llm.warc import archive, archive_folder, parse_records, read_records

    folder = archive_folder(spark)
    archive(table(spark, sf_dir, "pages"), folder, min_bytes=1000)
    found = cut(parse_records(read_records(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, folder)
    return found


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velatura.llm.near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from velatura.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from velatura.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velatura.llm.pii_tagger import KINDS, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velatura.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velatura.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from velatura.llm.quality_classifier import quality_scores, train

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_quality_rules, op3_warc_archive, op4_simhash_near_dedup, op5_best_fit_packing, op6_token_counts, op7_pii_tagger, op8_line_dedup, op9_jump_sharding, op10_quality_classifier)}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": """
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT item_id, i, w[i:i + 9] AS words, len(w[i:i + 9]) AS n FROM starts),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs),
texts AS (SELECT doc_id, p, n, w[p:p + n - 1] AS words FROM places, (SELECT DISTINCT n FROM windows) WHERE p + n - 1 <= len(w)),
found AS (SELECT t.doc_id, t.p, t.n, x.item_id, x.i FROM texts t JOIN windows x ON t.n = x.n AND t.words = x.words),
hit AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
islands AS (SELECT doc_id, item_id, p - i AS diagonal, p, n, p - row_number() OVER (PARTITION BY doc_id, item_id, p - i ORDER BY p) AS island FROM found),
longest AS (SELECT doc_id, max(n_words) AS longest_match FROM (SELECT doc_id, max(p + n) - min(p) AS n_words FROM islands GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(l.longest_match, 0)::BIGINT AS longest_match
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id) LEFT JOIN longest l USING (doc_id)""",
    "op3_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT html, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest, CASE WHEN g.keeper IS NULL OR g.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.keeper <> p.page_id THEN g.keeper END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html""",
    "op8_line_dedup": """
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
lines AS (
  SELECT doc_id, n, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split),
shared AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.n, l.line, s.k IS NOT NULL AND l.doc_id <> s.keeper AS lost FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_jump_sharding": """
WITH RECURSIVE walk(doc_id, n, here, ahead, state) AS (
  SELECT doc_id, n, -1::BIGINT, 0::BIGINT, doc_id::HUGEINT FROM documents, (VALUES (16), (17)) AS counts(n)
  UNION ALL
  SELECT doc_id, n, ahead,
    floor((ahead + 1)::DOUBLE * (2147483648.0::DOUBLE / (((state * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT,
    (state * 2862933555777941757 + 1) % 18446744073709551616
  FROM walk WHERE ahead < n),
crc_table AS (
  SELECT list(list_reduce([n::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS r(n)),
sums AS (
  SELECT doc_id, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents, crc_table),
ends AS (SELECT doc_id, max(here) FILTER (n = 16) AS shard, max(here) FILTER (n = 17) AS grown_shard FROM walk GROUP BY doc_id)
SELECT d.doc_id, (strlen(coalesce(d.text, '')) + 1)::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law, e.shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY e.shard ORDER BY d.doc_id) - 1)::BIGINT AS slot, e.grown_shard::INTEGER AS grown_shard
FROM documents d JOIN ends e USING (doc_id) JOIN sums s USING (doc_id)""",
}
