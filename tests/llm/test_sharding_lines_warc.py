import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from velatura.llm import line_dedup, warc
from velatura.llm.sharding import assign_shards, jump_shard

M = (1 << 64) - 1


def jump(key, n):
    here, ahead = -1, 0
    while ahead < n:
        here = ahead
        key = (key * 2862933555777941757 + 1) & M
        ahead = int((here + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return here


@pytest.mark.parametrize("n", [1, 2, 16, 17, 500])
def test_jump_hash_equals_the_published_loop(spark, n):
    rng = random.Random(n)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [0, 1, -1, None]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shard(F.col("k"), n).alias("s")).collect()
    assert all(r.s == jump((r.k or 0) & M, n) for r in got)


def test_shards_are_gapless_and_grow_only_into_the_new_one(spark):
    rows = [(i, f"t{i % 7}", "x", 1.0) for i in range(500)] + [(None, None, "x", 1.0)] * 3 + [(5, "t5", "x", 1.0)] * 40
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string, slot double")).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        assert r.size == (1 if r.doc_id is None else len(f"t{r.doc_id % 7}") + 1)
        assert r.text_crc32 == (0 if r.doc_id is None else zlib.crc32(f"t{r.doc_id % 7}".encode()))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_lines(docs, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        def lost(line):
            h = held[key(line)]
            return len(key(line)) >= min_chars and len(h) >= min_docs and d != max((x for x in h if x is not None), default=None)
        kept = [x for x in lines if not lost(x)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = ["A line that many documents do share", "  a LINE that many documents do share\t", "éééééééééééééééééééé", "ééééééééééééééééééé", "short", "", "unique %d and long enough to count"]


RANGES = {"most_bits": 1 << 6}  # too few bits for these lines, so that filters go by ranges of hashes


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": -1}, RANGES, RANGES | {"broadcast_bytes": -1, "range_bits": 64}])
def test_line_dedup_equals_brute_force(spark, limits):
    rng = random.Random(1)
    docs = [(i, "\n".join(x % i if "%d" in x else x for x in rng.choices(LINES, k=rng.randrange(6)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, LINES[0]), (7, LINES[0]), (7, LINES[0]), (102, "x" * 30000 + "\n" + LINES[0])]
    df = spark.createDataFrame([(d, t, "c", 5) for d, t in docs], "doc_id long, text string, n_lines string, n_chars long").drop("n_lines")
    got = line_dedup.dedup_lines(df, counts=True, **limits).collect()
    exp = sorted(brute_lines(docs), key=repr)
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got], key=repr) == exp
    assert all(r.n_chars == (len(r.text) if r.n_dropped else 5) for r in got)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": -1}, RANGES])
def test_ids_of_other_types_and_clashing_names(spark, limits):
    rows = [("1", LINES[0], 1, 2, 3), ("2", LINES[0] + "\nshort", 1, 2, 3), ("10", LINES[0], 1, 2, 3), (None, LINES[0], 1, 2, 3), ("9", None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, own_id int, lost_id int, lost_keys int")
    got = line_dedup.dedup_lines(df, **limits)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {"1": "", "2": "short", "10": LINES[0], None: "", "9": None}


def test_only_suspected_repeats_shuffle(spark):
    """Of keys in one document only, the merged filter knows few."""
    docs = [(i, "\n".join([f"line {i} {j} that no other document has" for j in range(20)] + [f"line that documents {i // 2 * 2} and the next have"] + [LINES[0]] * (i % 50 == 0))) for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    for limits, most in (({}, 500), ({"most_bits": 1 << 12}, 4000)):  # 21,500 keys in 65,536 bits; by ranges of hashes and a filter of 4,096 bits
        confirmed, found = line_dedup.confirmed_keys(df, **limits)
        assert [r.keeper for r in confirmed.collect()] == [950]
        assert 20 <= found.count() < most, limits


PAGES = [(1, "u", "a" * 1200), (2, "u", "a" * 1200), (9, "u\r\nX: y", "a" * 1200), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "WARC/1.0\r\n\r\n" * 100 + "é"), (None, "u", "a" * 1200), (7, "u", "b" * 70000), (7, "u", "b" * 70000)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(p, u, h, "x") for p, u, h in PAGES], "page_id long, url string, html string, address string")
    folder = str(tmp_path / "a")
    warc.archive(df, folder)
    got = warc.parse_records(warc.read_records(spark, folder)).collect()
    assert len(got) == len(PAGES)
    payloads = defaultdict(list)
    for p, _, h in PAGES:
        payloads[p].append((h or "").encode())
    for r in got:
        body = payloads[r.page_id][0]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        keeper = 9 if body == b"a" * 1200 else None
        revisit = keeper is not None and r.page_id != keeper
        assert (r.record_type, r.refers_to) == (("revisit", keeper) if revisit else ("response", None))
        assert bytes(r.payload) == body
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(h or "") for _, _, h in PAGES})
    own, refers = [], set()
    for r in warc.read_records(spark, folder).collect():
        assert bytes(r.record).startswith(b"WARC/1.0\r\n") and bytes(r.record).endswith(b"\r\n\r\n")
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(rest) - 4
        page = int(fields[b"WARC-Page-ID"]) if fields[b"WARC-Page-ID"] else None
        http, _, held = rest[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK") and held == (b"" if fields[b"WARC-Type"] == b"revisit" else payloads[page][0])
        own.append(fields[b"WARC-Record-ID"])
        refers |= {fields[b"WARC-Refers-To"]} if b"WARC-Refers-To" in fields else set()
    assert len(set(own)) == len(PAGES) and refers <= set(own)
    warc.write_files(spark, folder, str(tmp_path / "w"))
    back = warc.read_files(spark, str(tmp_path / "w") + "/*.txt").collect()
    assert sorted((r.page_id or 0, r.record_type) for r in back) == sorted((r.page_id or 0, r.record_type) for r in got)


def test_a_hot_payload_is_read_in_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPY_RECORDS", 10)
    df = spark.createDataFrame([(i, "u", "a" * 1500 if i % 3 else f"{i}" * 400) for i in range(150)], "page_id long, url string, html string")
    folder = str(tmp_path / "h")
    warc.archive(df, folder)
    assert spark.read.parquet(f"{folder}/payloads").filter("copies = 10").count() == 1
    assert spark.read.parquet(f"{folder}/headers").groupBy("address", "copy").count().agg(F.max("count")).first()[0] <= 20
    got = {r.page_id: (r.record_type, r.refers_to, bytes(r.payload)) for r in warc.parse_records(warc.read_records(spark, folder)).collect()}
    assert got == {i: ("response", None, f"{i}".encode() * 400) if i % 3 == 0 else ("response" if i == 149 else "revisit", None if i == 149 else 149, b"a" * 1500) for i in range(150)}
    warc.archive(df.limit(0), str(tmp_path / "e"))
    assert warc.parse_records(warc.read_records(spark, str(tmp_path / "e"))).count() == 0


def test_a_join_with_hot_keys(spark, monkeypatch):
    from velatura.llm import common

    left = spark.createDataFrame([(i % 7 if i % 2 else 100, i) for i in range(3000)] + [(None, -1), (55, -2)], "k int, v int")
    right = left.filter("k is not null and k <> 55").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("k") * 2)
    exp = sorted(map(tuple, left.join(right.drop("n"), "k", "left").collect()), key=repr)
    for few, share in ((1 << 17, 1000), (0, 1000), (0, 3), (0, 1)):
        monkeypatch.setattr(common, "FEW_ROWS", few)
        monkeypatch.setattr(common, "HOT_SHARE", share)
        assert sorted(map(tuple, common.attach(left, right, "k", "n", 3000).collect()), key=repr) == exp


def test_checkpoint_folder_is_shared_on_a_cluster():
    from velatura.functions.lineage import checkpoint_folder

    assert checkpoint_folder("hdfs://x/y", "spark://host:7077") == "hdfs://x/y" and checkpoint_folder(None, "local[4]")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            checkpoint_folder(None, master)


def test_a_changed_payload_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"y")).write.parquet(f"{folder}/p2")
    import shutil

    shutil.rmtree(f"{folder}/payloads")
    shutil.move(f"{folder}/p2", f"{folder}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_records(spark, folder).collect()
