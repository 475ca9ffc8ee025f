import random
from collections import Counter

import pytest

from velatura.llm import near_dedup


def brute_sets(texts, words=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute_groups(texts, words=5, num=4, den=5):
    sets, root = brute_sets(texts, words), list(range(len(texts)))
    for _ in texts:
        before = list(root)
        for i in range(len(texts)):
            for j in range(i):
                if root[i] != root[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        if root == before:
            return root


def near_copies(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choices(vocabulary, k=rng.randrange(40, 160)) for _ in range(8)]
    texts = []
    for i in range(n):
        own = list(base[i % 8])
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    return [*texts, None, "", " \n", "One", "one", "one two three four", "license text " * 40]


@pytest.mark.parametrize("list_members", [64, 3])
def test_similar_documents_equal_brute_force(spark, list_members):
    texts = near_copies(random.Random(8), 90)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    exp = brute_groups(texts)
    got = {r.doc_id: r.root for r in near_dedup.similar_documents(df, list_members=list_members).collect()}
    groups = Counter(tuple(sorted(d for d in got if got[d] == r)) for r in set(got.values()))
    assert groups == Counter(tuple(i for i in range(len(texts)) if exp[i] == r) for r in set(exp))
    assert any((near_dedup.fingerprint(texts[i].encode()) ^ near_dedup.fingerprint(texts[exp[i]].encode())).bit_count() > 2 for i in range(90))
    assert near_dedup.similar_documents(df.limit(0)).count() == 0


def test_stage_drops_copies_that_differ_in_some_words(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = near_copies(random.Random(9), 60)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted((r for r in rows if r[0] in set(brute_groups(texts))), key=lambda r: r[0])


@pytest.mark.parametrize("broadcast_ids", [1 << 20, -1])
def test_one_row_a_group_with_repeated_and_null_ids(spark, monkeypatch, broadcast_ids):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", broadcast_ids)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (1, a), (None, a + " end"), (None, c), (None, c + " end"), (None, d), (2, d + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in near_dedup.drop_similar(df).collect())
    assert got in (Counter([(1, a), (1, b), (None, t), (2, d + " end")]) for t in (c, c + " end"))
