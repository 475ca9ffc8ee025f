from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        last = i == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    packed = docs.collect()
    ran = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, ran))
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


def test_run_equals_brute_force(spark):
    """Every stage by plain Python: the model's scores, counted lines, all pairs of five-word shingle sets, windows, and the tokenizer's ids."""
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from test_near_copies import brute_groups
    from test_sharding_lines_warc import brute_lines
    from test_text_operators import brute_leaks
    from tokenizers import Tokenizer

    from velatura.llm.quality_classifier import score, train

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    weights = train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if score(weights, (r.text or "").encode()) >= 0.3]
    rows = [(d, t) for d, _, _, t in brute_lines(rows)]
    root = brute_groups([t for _, t in rows])
    least = {}
    for r, (d, _) in zip(root, rows):
        least[r] = min(d, least.get(r, d))
    rows = [(d, t) for r, (d, t) in zip(root, rows) if d == least[r]]
    leaks = brute_leaks(rows, items)
    rows = [(d, t) for d, t in rows if leaks[d][1] == 0]
    tok, exp = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            exp[(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == exp
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and len(filled) <= 1.05 * sum(filled.values()) / 1024 + 1


LONG = [" ".join(f"{c}{i}" for i in range(80)) for c in "abc"]
ROWS = [(1, LONG[0]), (1, LONG[0]), (1, LONG[1]), (2, LONG[0] + " end"), (None, LONG[0]), (None, LONG[2]), (3, None), (4, ""), (5, None), (6, "x " * 30_000), (7, "word " * 9)]


@pytest.fixture
def small(spark):
    """Rows with nulls, repeated ids and rows, empty and long texts, and columns whose names the operators might use themselves."""
    rows = [(d, t, "en", "s", len(t or ""), "x", 1, 2, 3, 4) for d, t in ROWS]
    names = "row string, own int, fp int, id int, __row int"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def test_stages_with_odd_rows(spark, small):
    """The quality stage judges each row alone, the next two leave one row of each group, and packing has all pieces of every row."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, small, SF)
        assert got.columns == small.columns, name
        kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
        if name == "near_dedup":
            assert kept == sorted([(1, LONG[0]), (1, LONG[1]), (None, LONG[2]), (3, None), (6, "x " * 30_000), (7, "word " * 9)], key=repr)
        elif name == "quality_classifier":
            assert all(x in ROWS for x in kept) and len({kept.count(x) in (0, ROWS.count(x)) for x in ROWS}) == 1
        else:
            assert kept == sorted(ROWS, key=repr), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, small, SF).collect()
    assert len([r for r in pieces if r.piece == 0]) == len(ROWS) and max(r.length for r in pieces) <= 1024


def test_stages_of_an_empty_table(spark, small):
    docs = small.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0 and docs.columns == small.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_run_leaves_no_folders(spark):
    from velatura.llm.common import prepare

    prepare(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = {p.name for p in folder.glob("*-*") if p.name.startswith(("pipeline-", "warc-"))}
    corpus_pipeline.run(spark, SF).count()
    from velatura.llm.registry import QUERIES

    QUERIES["op3_warc_archive"](spark, SF).count()
    assert {p.name for p in folder.glob("*-*") if p.name.startswith(("pipeline-", "warc-"))} == before
