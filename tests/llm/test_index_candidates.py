import random

import pytest
from test_near_copies import brute_groups, near_copies

from velatura.llm import common, near_dedup


def groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, least = near_dedup.similar_documents(df).collect(), {}
    for r in found:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    return [least[r.root] for r in sorted(found, key=lambda r: r.doc_id)]


def test_every_fingerprint_enters_the_index_and_it_alone_finds_copies(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for i in range(40):
        own = [f"v{rng.randrange(5_000)}" for _ in range(300)]
        texts += [" ".join(own), " ".join([*own[:200], "changed", *own[201:]])]
    entered, whole = [], near_dedup.hamming_links
    monkeypatch.setattr(near_dedup, "hamming_links", lambda prints, limit: entered.extend(r.fp for r in prints.collect()) or whole(prints, limit))
    monkeypatch.setattr(near_dedup, "_list_pairs", lambda level, star: (lambda batches: iter(()), "a long, b long"))
    got = groups(spark, [*texts, None])
    assert sorted(entered) == sorted({near_dedup._signed(near_dedup.word_fingerprint(t.encode())) for t in [*texts, ""]})
    assert got == brute_groups([*texts, None]) == [i - i % 2 for i in range(80)] + [80]


@pytest.mark.parametrize("index, few_rows", [(True, common.FEW_ROWS), (False, common.FEW_ROWS), (True, -1)])
def test_lists_complete_what_the_index_leaves_apart(spark, monkeypatch, index, few_rows):
    monkeypatch.setattr(common, "FEW_ROWS", few_rows)
    texts = near_copies(random.Random(12), 60)
    if not index:
        whole = near_dedup.hamming_links
        monkeypatch.setattr(near_dedup, "hamming_links", lambda prints, limit: whole(prints, limit).limit(0))
    assert groups(spark, texts) == brute_groups(texts)


def test_rotated_texts_of_one_fingerprint_stay_apart(spark):
    """Equal words in another order have equal fingerprints, and few common shingles if shuffled."""
    rng, texts = random.Random(13), []
    for _ in range(6):
        own = [f"u{rng.randrange(400)}" for _ in range(120)]
        texts += [" ".join(own), " ".join(own[60:] + own[:60]), " ".join(rng.sample(own, len(own)))]
    got = groups(spark, texts)
    assert got == brute_groups(texts) and len(set(got)) == 12


@pytest.mark.parametrize("node_members", [near_dedup.NODE_MEMBERS, 4])
def test_index_of_five_bits_equals_all_pairs(spark, node_members):
    rng, prints = random.Random(14), []
    for _ in range(30):
        own = rng.getrandbits(64)
        prints += [own, *(own ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for _ in range(6))]
    prints = sorted(set(prints))
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 5]
    assert near
    common.prepare(spark)
    df = spark.createDataFrame([(near_dedup._signed(x),) for x in prints], "fp long")
    found = [tuple(x % (1 << 64) for x in r) for r in near_dedup.hamming_links(df, 5, node_members).collect()]

    def connected(links):
        root = {x: x for x in prints}
        for _ in prints:
            before = dict(root)
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root

    assert connected(found) == connected(near)
