import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velatura.functions.spans import SPAN, fold
from velatura.operators import pseudonymise as P
from velatura.operators import rows as R
from velatura.plans.catalogue import QUERIES

KIND = f"doc_id long, text string, candidates array<{SPAN}>"


def brute_merge(text, cands):
    order = sorted(cands, key=lambda c: (not c[4], not (c[5] == "regex" and c[0] != "DATE"), -c[3], -(c[2] - c[1]), c[6]))
    kept = []
    for c in order:
        if all(c[2] <= k[1] or c[1] >= k[2] for k in kept):
            kept.append(c)
    word = lambda ch: ch.isalnum() or ch == "_"
    out = []
    for label, s, e, *_ in sorted(kept, key=lambda k: k[1]):
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s == e:
            continue
        while s > 0 and word(text[s - 1]) and word(text[s]):
            s -= 1
        while e < len(text) and word(text[e]) and word(text[e - 1]):
            e += 1
        out.append((label, s, e))
    merged = []
    for label, s, e in sorted(out, key=lambda x: (x[1], -x[2])):
        if merged and (s < merged[-1][2] or s == merged[-1][2] and label == merged[-1][0]):
            merged[-1] = (merged[-1][0], merged[-1][1], max(e, merged[-1][2]))
        else:
            merged.append((label, s, e))
    return merged


@pytest.mark.parametrize("engine", ["native", "arrow"])
def test_merge_equals_brute_force(spark, engine):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        text = "".join(rng.choices("ab é_ .\n1", k=60))
        cands = []
        for k in range(rng.randrange(9)):
            s = rng.randrange(58)
            cands.append((rng.choice(["CF", "DATE", "CITY"]), s, min(60, s + rng.randrange(1, 9)), rng.choice([0.5, 0.9]), rng.random() < 0.3, rng.choice(["regex", "model"]), k))
        rows.append((i, text, cands))
    got = {r.doc_id: [(s.label, s.start, s.end) for s in r.spans] for r in P.merge(spark.createDataFrame(rows, KIND), engine=engine).collect()}
    for i, text, cands in rows:
        assert got[i] == brute_merge(text, cands), (text, cands)


def brute_restore(text, mapping):
    """One name after the other, the longest first."""
    for name in sorted(mapping, key=lambda k: -len(k)):
        text = re.sub(r"\**\[?\s*" + re.escape(name[1:-1]) + r"\s*\]?\**", lambda m, name=name: mapping[name], text)
    return text


def test_restore_equals_one_name_after_the_other():
    rng = random.Random(4)
    mapping = {"[X_1]": "a$1", "[X_12]": "b", "[EMAIL_3]": "c d", "[LONG_X_1]": "e", "[X_100]": "f"}
    parts = ["[X_1]", "X_12", "[ EMAIL_3 ]", "**[X_1]**", "X_13", "X_1000", "LONG_X_1", "LONG_X_2", " ", "*", "[", "]", "q", "\n", "EMAIL_"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert R.restore(text, mapping) == brute_restore(text, mapping), text


def test_restore_and_merge_are_linear():
    n = 20_000
    text = "w1 a@b.com, " * n
    began = time.time()
    spans = [("EMAIL", 12 * i + 3, 12 * i + 10, 0.9, False, "regex", i) for i in range(n)] + [("DATE", 12 * i, 12 * i + 2, 0.5, False, "model", n + i) for i in range(n)]
    entities = R.number(text, R.merge(text, spans))
    done, mapping, segments = R.rewrite(text, entities)
    assert len(entities) == 2 * n and R.restore(done, mapping) == text and "".join(s[2] or s[0] for s in segments) == done
    distinct = " ".join(f"u{i}@b.com" for i in range(n))
    done, mapping, _ = R.rewrite(distinct, R.number(distinct, R.merge(distinct, R.detect(distinct))))
    assert len(mapping) == n and R.restore(done, mapping).replace(" ", "") == distinct.replace(" ", "")
    assert R.merge("x" * 200_000, [("CF", i, i + 1, 0.9, False, "regex", i) for i in range(0, 200_000, 10)])[0][:3] == ("CF", 0, 200_000)
    assert R.restore(" " * 300_000 + "*" * 300_000, {"[X_1]": "v"}) == " " * 300_000 + "*" * 300_000
    assert time.time() - began < 20


def brute_analysis(text, model, excluded=()):
    """Every step by its definition: candidates, one against all, keys by casefold, and texts from back to front."""
    found = [c for c in [*model, *R.detect(text)] if c[0] not in excluded]
    numbers, names, out = {}, {}, text
    entities = brute_merge(text, found)
    for label, a, b in entities:
        key = (label, " ".join(text[a:b].split()).casefold())
        if key not in names:
            numbers[label] = numbers.get(label, 0) + 1
            names[key] = (f"[{label}_{numbers[label]}]", text[a:b])
    for label, a, b in reversed(entities):
        out = out[:a] + names[(label, " ".join(text[a:b].split()).casefold())][0] + out[b:]
    return out, dict(names.values()), len(entities)


VALUES = ["a.b@c.it", "A.B@C.IT", "00743110157", "RSSMRA85H12F205Y", "IT60 X054 2811 1010 0000 0123 456", "333-123-4567", "€ 12.500,00", "AB 123 CD", "www.example.org/x", "Prot. n. 456/2024", "12/06/1985", "4111 1111 1111 1111", "Straße", "STRASSE", "x", "Mario Rossi", "é", ",", "."]


@pytest.mark.parametrize("excluded", [(), ("EMAIL", "DATE")])
def test_analysis_equals_brute_force(spark, excluded):
    """All detectors and a recogniser's candidates, that overlap them and each other."""
    rng = random.Random(6)
    rows, models = [], []
    for i in range(250):
        text = "".join(rng.choice(VALUES) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(12)))
        own = [(rng.choice(["FULLNAME", "CITY", "DATE"]), a, min(len(text), a + rng.randrange(1, 12)), rng.choice([0.5, 0.95]), False, "model", k) for k in range(rng.randrange(5)) if text for a in [rng.randrange(len(text))]]
        rows.append((i, text, "x"))
        models.append((i, own))
    model = spark.createDataFrame([m for m in models if m[1]], f"doc_id long, model_candidates array<{SPAN}>")
    got = {r.doc_id: r for r in P.analyse(spark.createDataFrame(rows, "doc_id long, text string, n_chars string"), list(excluded), model=model).select("doc_id", "anonymized_text", "mapping", "n_entities", "segments", "entities", "excluded_tags").collect()}
    for (i, text, _), (_, own) in zip(rows, models):
        r = got[i]
        assert (r.anonymized_text, r.mapping, r.n_entities) == brute_analysis(text, own, excluded), text
        assert "".join(s.t for s in r.segments) == text and all(e.value == text[e.start : e.end] for e in r.entities) and list(r.excluded_tags) == sorted(excluded)


def brute_scrub(text, entries):
    """One value after the other, the longest first."""
    counts = {}
    for name, value, _ in sorted(entries, key=lambda e: (-len(e[1]), e[0])):
        text, n = re.subn(P.value_pattern(value), name, text, flags=re.I)
        counts[name] = n
    return text, counts


def test_scrub_equals_one_value_after_the_other():
    rng = random.Random(8)
    words = ["Mario", "Rossi", "ROSSI", "Anna", "Srl", "Bianchi-Neri", "a.b@c.it", "+39", "333", "Ros", "(Milano)"]
    for _ in range(1500):
        values = list({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(rng.randrange(5))})
        entries = [(f"[N_{i}]", v, sum(c.isalnum() for c in v) >= 2) for i, v in enumerate(values)]
        glued = rng.random() < 0.3
        text = "".join(rng.choice([*words, *values, "Ros-\nsi", "mario\n rossi"]) + rng.choice([" ", "" if glued else " ", ", ", "\n", "  "]) for _ in range(rng.randrange(10)))
        done, counts, missing, skipped, residual = P.scrub_text(text, entries)
        exp = brute_scrub(text, entries)
        assert (done, counts) == exp or glued and sum(counts.values()) >= sum(exp[1].values()), (text, values)
        assert missing == sorted(k for k, n in counts.items() if not n) and skipped == [] and residual == []


TEXT = "Mail a.b@c.it e A.B@C.IT, poi x@y.it; P.IVA 00743110157, ancora a.b@c.it."


def test_numbers_dictionary_and_way_back(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "niente")], "doc_id long, text string")
    a = P.analyse(df)
    got = {r.doc_id: r for r in a.collect()}
    assert got[1].anonymized_text == "Mail [EMAIL_1] e [EMAIL_1], poi [EMAIL_2]; P.IVA [PIVA_1], ancora [EMAIL_1]."
    assert got[1].mapping == {"[EMAIL_1]": "a.b@c.it", "[EMAIL_2]": "x@y.it", "[PIVA_1]": "00743110157"}
    assert (got[1].n_entities, got[1].n_unique, got[1].by_label) == (5, 3, {"EMAIL": 4, "PIVA": 1})
    assert "".join(s.ph or s.t for s in got[1].segments) == got[1].anonymized_text
    assert got[2].anonymized_text is None and got[3].anonymized_text == "" and got[4].segments[0].t == "niente"
    back = a.filter("doc_id = 1").select(P.restore(F.col("anonymized_text"), F.col("mapping")).alias("t")).first().t
    assert back == TEXT.replace("A.B@C.IT", "a.b@c.it")
    cut = P.analyse(df, excluded=["EMAIL"], reversible=False).filter("doc_id = 1").first()
    assert "[EMAIL" not in cut.anonymized_text and cut.mapping == {} and all(s.t is None for s in cut.segments if s.label)


def test_restore_reads_loose_placeholders_longest_first(spark):
    m = {"[X_1]": "a$1", "[X_12]": "b\\"}
    got = spark.createDataFrame([("**[X_1]** X_12 [ X_1 ] X_13", m)], "t string, m map<string,string>").select(P.restore(F.col("t"), F.col("m"))).first()[0]
    assert got == "a$1b\\a$1a$13"  # spaces around a name go with it


def test_unchanged_texts_come_back_exactly(spark, tmp_path):
    texts = [TEXT, "**a.b@c.it** e *x@y.it*", "[a.b@c.it]", "EMAIL_1 sta per [EMAIL_1], cioè a.b@c.it", "[ a.b@c.it ] **", "a.b@c.it]**", "", None, "niente"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert all(r.same for r in QUERIES["restore_roundtrip"](spark, str(tmp_path)).collect())
    a = P.analyse(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")).withColumn("changed", F.concat(F.lit("Ecco: "), "anonymized_text"))
    back = a.select(P.restore(F.col("changed"), F.col("mapping"), F.col("segments"))).first()[0]
    assert back == "Ecco: " + TEXT.replace("A.B@C.IT", "a.b@c.it")  # by names again


def test_a_recognisers_spans_come_in(spark):
    df = spark.createDataFrame([(1, "Mario Rossi abita a Roma il 12/06/1985")], "doc_id long, text string")

    def recogniser(texts):
        return [[("FULLNAME", 0, 11, 0.8), ("DATE", 28, 38, 0.99)] for _ in texts]

    model = P.recognise(df, recogniser)
    assert P.analyse(df, model=model).first().anonymized_text == "[FULLNAME_1] abita a Roma il [DATE_1]"


def test_windows(spark):
    for n in (0, 1, 119, 120, 121, 220, 221, 500):
        text = " " + " ".join(f"w{i}" for i in range(n)) + " "
        got = P.chunk_rows(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk").collect()
        words, exp, i = text.split(), [], 0
        while i < n:
            exp.append(" ".join(words[i : i + 120]))
            if i + 120 >= n:
                break
            i += 100
        assert [r.text for r in got] == exp and all(text[r.start : r.end] == r.text for r in got)


def test_scrub(spark):
    texts = spark.createDataFrame([(1, "Mario Ros-\nsi e MARIO  ROSSI, Rossini; RM e MI"), (2, "nulla")], "doc_id long, text string")
    entries = spark.createDataFrame([(1, "[N_1]", "Mario Rossi"), (1, "[P_1]", "M"), (1, "[C_1]", "Napoli")], "doc_id long, placeholder string, value string")
    got = {r.doc_id: r for r in P.scrub(texts, entries).collect()}
    assert got[1].scrubbed == "[N_1] e [N_1], Rossini; RM e MI" and got[1].occurrences == {"[N_1]": 2, "[C_1]": 0}
    assert got[1].not_found == ["[C_1]"] and got[1].skipped == ["[P_1]"] and got[1].residual == [] and got[2].scrubbed == "nulla"


def test_small_expressions(spark):
    df = spark.createDataFrame([("x[EMAIL_1]",), ("[EMAIL_1]y",), ("a [EMAIL_1]. b",), (None,)], "t string")
    assert [r[0] for r in df.select(P.glued_placeholder(F.col("t"))).collect()] == [True, True, False, False]
    folds = spark.createDataFrame([("  Straße  Nr ",), ("ﬁne",)], "t string").select(fold(F.col("t"))).collect()
    assert [r[0] for r in folds] == ["strasse nr", "fine"]


def test_plain_search_slices_and_words_of_a_batch():
    rng, parts = random.Random(3), ["ab", "AB", "abc", "_", "1", "12", " ", ".", "é", "ſ", "K", "s", "€", "İ", "[X_1]", "-"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randrange(25)))
        values = ["".join(rng.choices(["ab", "AB", "c", "1", ".", "_", "k", "s", "-"], k=rng.randrange(2, 5))) for _ in range(4)]
        entries = [(f"[X_{i}]", v) for i, v in enumerate(values) if sum(c.isalnum() for c in v) >= 2]
        scrubber = P.Scrubber(entries, False)
        by_patterns = P.Scrubber(entries, False)
        by_patterns.plain = None
        assert scrubber.plain is not None and sorted(scrubber.found(text)) == sorted(by_patterns.found(text)), (text, entries)
    seen = []
    out = R.sliced(lambda a: seen.append(a.nbytes) or a, [pa.array(["x" * 1000] * 5000 + ["y" * 3_000_000])])
    assert len(out) == 5001 and sorted(seen)[-2] <= R.SLICE_BYTES < sorted(seen)[-1] and R.sliced(lambda a: a, [pa.array([], pa.string())]).to_pylist() == []
    assert R.span_labels([(0, 2), (3, 5), (6, 9)], [(0, 2, "CITY_1"), (0, 5, "FIRSTNAME_2"), (6, 8, "CITY_3"), (0, 9, "NONE_1"), (None, None, "CITY_1")], {"CITY": "CITY", "FIRSTNAME": "FULLNAME"}) == ["B-FULLNAME", "I-FULLNAME", "O"]
