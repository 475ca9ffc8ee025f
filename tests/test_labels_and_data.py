import random
import re
from collections import Counter

from pyspark.sql import functions as F

from velatura.operators import dataset, evaluate, generate, labels
from velatura.sources import readers, writers
from velatura.streaming import pseudonymise as streaming


def brute_spans(ls):
    out, cur = [], None
    for i, x in enumerate([*ls, "O"]):
        t = None if x == "O" else x[2:]
        if cur and (t is None or x.startswith("B-") or t != cur[0]):
            out.append((*cur, i))
            cur = None
        if t and cur is None:
            cur = (t, i)
    return out


def test_label_spans_and_normalising(spark):
    rng = random.Random(1)
    rows = [(i, rng.choices(["O", "B-CITY", "I-CITY", "B-GIVENNAME", "I-SURNAME", "B-TITLE"], k=rng.randrange(12))) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, bio_labels array<string>")
    got = df.select("row_id", labels.label_spans(F.col("bio_labels")).alias("s"), labels.normalise(F.col("bio_labels")).alias("n")).collect()
    flat = Counter((r.row_id, r.type, r.start, r.end) for r in labels.label_span_rows(df).collect())
    by = dict(rows)
    for r in got:
        exp = brute_spans(by[r.row_id])
        assert [(s.type, s.start, s.end) for s in r.s] == exp
        before, norm = None, []
        for x in by[r.row_id]:
            t = {"GIVENNAME": "FULLNAME", "SURNAME": "FULLNAME", "CITY": "CITY"}.get(x[2:])
            norm.append("O" if t is None else ("I-" if t == before else "B-") + t)
            before = t
        assert list(r.n) == norm
    assert flat == Counter((i, *s) for i, ls in rows for s in brute_spans(ls))


def test_tokens_errors_and_recasing(spark):
    df = generate.examples(spark, 300, 5)
    checked = df.select("tokens", "bio_labels", labels.first_error(F.col("source_text"), F.col("tokens"), F.col("bio_labels"), F.col("entities")).alias("e"), labels.derivation_error(F.col("source_text"), F.col("tokens"), F.col("bio_labels"), F.col("entities")).alias("d"), labels.recase(F.col("tokens"), F.col("bio_labels"), F.col("row_id")).alias("r"))
    for r in checked.collect():
        assert r.e is None and r.d is None and len(r.r) == len(r.tokens) and "".join(r.r).lower() == "".join(r.tokens).lower()
    assert [r.source_text for r in df.orderBy("row_id").limit(5).collect()] == [r.source_text for r in generate.examples(spark, 300, 5).repartition(7).orderBy("row_id").limit(5).collect()]


def test_scores(spark):
    gold = spark.createDataFrame([(1, "CF", 0, 2), (1, "CITY", 3, 4), (2, "CF", 0, 1)], "row_id int, type string, start int, end int")
    pred = spark.createDataFrame([(1, "CF", 0, 2), (1, "CITY", 3, 5), (2, "DATE", 0, 1)], "row_id int, type string, start int, end int")
    o = evaluate.score_overall(gold, pred, ["row_id", "start", "end"]).first()
    assert (o.tp, o.fp, o.fn) == (1, 2, 2) and abs(o.precision - 1 / 3) < 1e-9 and abs(o.f1_macro - (2 / 3) / 2) < 1e-9


def test_dataset_operators(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", "a" if i % 3 else "b") for i in range(60)] + [(99, None, "a"), (98, None, "b")], "id long, text string, k string")
    assert sorted(r.id for r in dataset.drop_exact(df, "text", "id").collect()) == [*range(7), 98]
    capped = dataset.cap_per_key(df, "k", ["id"], 4).collect()
    assert Counter(r.k for r in capped) == {"a": 4, "b": 4}
    tagged = df.withColumn("tags", F.when(F.col("id") < 3, F.array(F.lit("RARE"))).otherwise(F.array(F.lit("CF"))))
    sub = dataset.stratified_sample(tagged, 20, "id", ["k"], floors={"RARE": 3}, default_floor=5)
    ids = [r.id for r in sub.collect()]
    assert len(ids) == len(set(ids)) == 20 and {0, 1, 2} <= set(ids)
    assert dataset.parse_tags(" cf; iban,CF ") == ["CF", "IBAN"] and dataset.parse_flag("sì", False) and dataset.parse_boosts(["org=6"]) == {"ORG": 6.0}
    v = spark.createDataFrame([("m-v1.9",), ("m-v1.10",), ("m",)], "n string")
    assert dataset.latest_version(v, "n").first().n == "m-v1.10"


def test_drop_exact_keeps_every_distinct_text(spark):
    rows = [(5, "A"), (5, "B"), (3, "C"), (5, "A"), (None, "A"), (None, "D"), (None, "D"), (7, None), (6, None), (8, ""), (2, "C")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("d", F.lit(1)).withColumn("row", F.lit(2))
    assert Counter((r.id, r.text) for r in dataset.drop_exact(df, "text", "id").collect()) == Counter([(5, "A"), (5, "B"), (2, "C"), (None, "D"), (6, None), (8, "")])


def test_weights_and_choice_on_both_sides_of_their_limit(spark):
    boosts = spark.createDataFrame([(f"T{i}", float(1 + i % 9)) for i in range(2000)] + [("T5", 2.0)], "tag string, weight double")
    templates = spark.createDataFrame([(i, [f"T{i}", f"T{i + 1}"] if i % 10 else []) for i in range(300)], "id long, tags array<string>")
    of = lambda i: float(1 + i % 9)
    exp = {i: max(of(i), of(i + 1)) if i % 10 else 1.0 for i in range(300)}
    keys = spark.createDataFrame([(k, k / 997) for k in range(997)] + [(997, 1.0), (998, 0.0)], "k long, u double")
    total, ends = sum(exp.values()), []
    for i in range(300):
        ends.append((ends[-1] if ends else 0.0) + exp[i])
    for few in (10_000, 10):
        weights = dataset.template_weights(templates, boosts, few_rows=few)
        assert {r.id: r.weight for r in weights.collect()} == exp
        got = {r.k: r.id for r in dataset.weighted_choice(keys, weights, few_rows=few).collect()}
        assert got == {k: min(299, sum(e <= u * total for e in ends)) for k, u in [(k, k / 997) for k in range(997)] + [(997, 1.0), (998, 0.0)]}


def test_long_labels_and_tokens_stay_whole(spark):
    long = "B-" + "X" * 5000
    df = spark.createDataFrame([(1, [long, "O"], ["ab" * 80_000, "c"])], "row_id long, bio_labels array<string>, tokens array<string>")
    r = df.select(labels.tags_of(F.col("bio_labels")).alias("t")).first()
    assert list(r.t) == ["X" * 5000]
    assert {x.label for x in labels.label_vocabulary(df).collect()} == {long, "I" + long[1:], "O"}
    cases = df.select(F.explode(F.sequence(F.lit(1), F.lit(60))).alias("s"), "*")
    for r in cases.select(labels.recase(F.col("tokens"), F.transform("tokens", lambda _: F.lit("B-CITY")), F.col("s")).alias("x")).collect():
        assert [len(t) for t in r.x] == [160_000, 1]


def test_grammar_fills_every_slot():
    """Every slot: places are exact, labels are those it may bring, check digits are right, codes have their legal lengths."""
    from velatura.functions import plain

    shapes = {"CIG": r"[A-Z0-9]{10}", "CUP": r"[A-Z]\d\d[A-Z]\d{11}", "CONTO": r"\d{12}", "IDCARDNUM": r"C[A-Z]\d{5}[A-Z]{2}", "TARGA": rf"[{generate.PLATE_LETTERS}]{{2}} \d{{3}} [{generate.PLATE_LETTERS}]{{2}}", "PROVINCE": "[A-Z]{2}", "ZIPCODE": r"\d{5}"}
    kinds = Counter()
    for slot in generate.SLOTS:
        for i in range(150):
            text, entities = generate.filled(f"x {{{slot}}}.", generate.Draws(3, i))
            assert text.startswith("x ") and text.endswith(".") and {e[1] for e in entities} <= generate.SLOT_LABELS[slot]
            assert entities or slot == "TRIBUNAL"
            for value, label, a, b in entities:
                assert text[a:b] == value and value
                kinds[label] += 1
                assert re.fullmatch(shapes.get(label, ".+"), value, re.S), (label, value)
                assert {"CF": plain.tax_code_ok, "PIVA": plain.vat_ok, "IBAN": plain.iban_ok}.get(label, bool)(value)
    assert len(generate.SLOTS) == 33 and set(kinds) == set().union(*generate.SLOT_LABELS.values())


def test_ten_kinds_of_organisations():
    names = {generate.filled("{ORG}", generate.Draws(1, i))[0] for i in range(3000)}
    assert len(generate.GENERATOR.rules["ORG"][1]) == 10
    for part in ("GmbH", "gmbh", "srl", "S.R.L.", "Studio Legale", "& Associati", "Banca ", "Consorzio", "F.lli", "& Figli", "Group", "Northwind"):
        assert any(part in n for n in names), part
    assert any(re.fullmatch("[A-Z]{2,4}", n) for n in names) and "Zelvia" in names


def test_contribution_goes_on_until_it_has_enough(spark):
    few = ("Appalto CIG {CIG}.", "Provincia {PROVINCE}.")
    got = generate.contribution(spark, 40, 1, templates=few, cap=100, exhausted=300).collect()
    assert len(got) == 40 == len({r.source_text for r in got})
    # The second template can give eight texts only, and the first is capped.
    got = generate.contribution(spark, 500, 1, templates=few, cap=60, exhausted=300).collect()
    assert Counter(r.template_id for r in got) == {0: 60, 1: 8}


def test_template_bank_grows(spark):
    bank = spark.createDataFrame([(i, *x) for i, x in enumerate(generate.BANK)], "id int, doc_type string, text string")
    drafts = spark.createDataFrame([(1, "a", "```txt\nNuovo: {EMAIL}\\n```"), (2, "a", "niente"), (3, "b", "{ZZZ}"), (4, "b", generate.BANK[0][1]), (5, "b", "Nuovo: {EMAIL}"), (6, "c", "Altro {CF}")], "n int, doc_type string, text string")
    grown, refused = generate.append_templates(bank, drafts)
    n = len(generate.BANK)
    assert [(r.id, r.text) for r in grown.filter(F.col("id") >= n).orderBy("id").collect()] == [(n, "Nuovo: {EMAIL}"), (n + 1, "Altro {CF}")]
    assert {r.n: r.error for r in refused.collect()} == {2: "no slots", 3: "unknown slots", 4: "known", 5: "known"}
    assert bank.filter(generate.template_error(F.col("text")).isNotNull()).count() == 0


def test_plates_and_augmentation(spark):
    plates = generate.plate_corpus(spark, 200, 2).collect()
    assert len({r.source_text for r in plates}) == len(plates)
    assert all(not [e for e in r.entities if e.label == "TARGA"] for r in plates if r.category == "hard_negative")
    rows = generate.examples(spark, 40, 1).select("row_id", "tokens", "bio_labels")
    for r in generate.augment(rows, ("C.F. {CF}.",), 3).collect():
        assert len(r.tokens) == len(r.bio_labels) and "B-CF" in r.bio_labels
        assert all(x[0] != "I" or i and r.bio_labels[i - 1][2:] == x[2:] for i, x in enumerate(r.bio_labels))


def test_sources_and_sinks(spark, tmp_path):
    ex = generate.examples(spark, 20, 1)
    writers.write_jsonl(ex.drop("row_id"), str(tmp_path / "ex"))
    assert readers.read_examples(spark, str(tmp_path / "ex")).count() == 20
    assert readers.existing(spark, [str(tmp_path / "ex"), str(tmp_path / "no")]) == [str(tmp_path / "ex")]
    (tmp_path / "d").mkdir()
    for name, raw in (("a.txt", "è".encode()), ("b.txt", "è".encode("utf-16")), ("c.md", b"\xe8xy"), ("d.pdf", b"%PDF-1.4"), ("e.bin", b"x")):
        (tmp_path / "d" / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got["a.txt"] == ("è", None) and got["b.txt"] == ("è", None) and got["c.md"] == ("èxy", None) and got["d.pdf"] == (None, "pdf") and got["e.bin"][1] == "unsupported"
    spark.createDataFrame([("Ciao Mario Rossi", "[(5, 10, 'FIRSTNAME_1'), (11, 16, 'LASTNAME_1'), (0, 4, 'O')]")], "unmasked_text string, span_labels string").write.parquet(str(tmp_path / "p"))
    assert list(readers.read_span_corpus(spark, str(tmp_path / "p")).first().bio_labels) == ["O", "B-FULLNAME", "B-FULLNAME"]
    one = spark.createDataFrame([("v1", 1, 0.5)], "v string, t int, f double")
    at = str(tmp_path / "r")
    assert writers.read_registry(spark, at) is None
    for f in (0.5, 0.7):
        writers.write_registry(spark, at, one.withColumn("f", F.lit(f)), "v", "t")
    writers.write_registry(spark, at, one.withColumn("v", F.lit("v0")).withColumn("t", F.lit(0)), "v", "t")
    (tmp_path / "r" / "state-000000000099").mkdir()  # what a crash before the commit leaves
    assert [(r.v, r.f) for r in writers.read_registry(spark, at).orderBy("t").collect()] == [("v0", 0.5), ("v1", 0.7)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a.b@c.it"), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    streaming.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "dict")).awaitTermination(120)
    assert {r.doc_id: r.anonymized_text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "[EMAIL_1]", 2: "x"}
    assert spark.read.parquet(str(tmp_path / "dict")).first().value == "a.b@c.it"


def test_stable_ids_of_rows(spark, tmp_path):
    lines = [f'{{"language": "{"it" if i % 3 else ""}", "tokens": ["a{i % 7}", "b"], "bio_labels": ["B-CITY", "{"O" if i % 2 else "B-CF"}"], "source_text": "t{i % 7}"}}' for i in range(40)] + ["not json", '{"tokens": ["x"], "bio_labels": []}']
    for name, order in (("one", lines), ("two", lines[::-1])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.jsonl").write_text("\n".join(order) + "\n")
    paths = [str(tmp_path / "one" / "f.jsonl"), str(tmp_path / "missing.jsonl")]
    index = readers.index_rows(spark, paths)
    ids = {r.row_id for r in index.collect()}
    assert len(ids) == 40 == index.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        assert {r.row_id for r in readers.index_rows(spark, paths).collect()} == ids
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    chosen = index.filter(F.array_contains("tags", "CF"))
    assert Counter(r.source_text for r in readers.reread(spark, paths, chosen).collect()) == Counter(f"t{i % 7}" for i in range(0, 40, 2))
    assert readers.index_rows(spark, [str(tmp_path / "no")]).count() == 0


def test_stratified_sample_equals_plain_steps(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.choice([["A"], ["A", "B"], [], ["C"] if i % 40 == 0 else ["A"]])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s string, l string, tags array<string>")
    u = {r.id: r.u for r in df.select("id", labels.draw(7, F.col("id")).alias("u")).collect()}
    size, floors, chosen = 90, {"C": 6, "B": 30}, []
    order = sorted(rows, key=lambda r: (u[r[0]], r[0]))
    counts = Counter(t for r in rows for t in r[3])
    for tag, _ in sorted(counts.items(), key=lambda x: (x[1], x[0])):
        have = sum(tag in r[3] for r in rows if r[0] in chosen)
        need = min(floors.get(tag, 10) - have, size - len(chosen))
        chosen += [r[0] for r in order if tag in r[3] and r[0] not in chosen][: max(0, need)]
    pools = Counter((r[1], r[2]) for r in rows)
    room = size - len(chosen)
    more = []
    for key, pool in sorted(pools.items(), key=lambda x: (-x[1], x[0])):
        short = max(0, round(size * pool / len(rows)) - sum((r[1], r[2]) == key for r in rows if r[0] in chosen))
        own = [r[0] for r in order if (r[1], r[2]) == key and r[0] not in chosen][: max(0, min(short, room))]
        room -= short
        more += own
    chosen += more
    chosen += [r[0] for r in order if r[0] not in chosen][: size - len(chosen)]
    assert {r.id for r in dataset.stratified_sample(df, size, "id", ["s", "l"], floors=floors, default_floor=10, seed=7).collect()} == set(chosen)
    assert [r.id for r in dataset.sample_rows(df, "id", 20, 7).collect()] == [r[0] for r in order[:20]]


def test_settings(tmp_path):
    from velatura.functions import settings

    folder = str(tmp_path)
    assert settings.resolve({}, folder, {}) == {"excluded_tags": [], "mapping_enabled": True}
    (tmp_path / "preferences.json").write_text('{"excluded_tags": ["AGE"], "other": 1}')
    assert settings.resolve({}, folder, {})["excluded_tags"] == ["AGE"]
    assert settings.save(folder, mapping_enabled="no") == {"excluded_tags": ["AGE"], "other": 1, "mapping_enabled": False}
    assert settings.resolve({}, folder, {}) == {"excluded_tags": ["AGE"], "mapping_enabled": False}
    env = {"VELATURA_EXCLUDED_TAGS": "cf; iban", "VELATURA_MAPPING": "1"}
    assert settings.resolve({}, folder, env) == {"excluded_tags": ["CF", "IBAN"], "mapping_enabled": True}
    assert settings.resolve({"excluded_tags": ["x"]}, folder, env)["excluded_tags"] == ["X"] and settings.resolve({}, folder, {"VELATURA_EXCLUDED_TAGS": ""})["excluded_tags"] == []
    (tmp_path / "settings.json").write_text("{damaged")
    assert settings.resolve({}, folder, {})["excluded_tags"] == ["AGE"]


def test_validation_set_row_by_row(spark):
    """Both corpora's rows are the first by their draws; every other row is a row that wasn't taken, with one filled snippet put in."""
    rows = [(i, [f"w{i}", "b", ".", "c", f"e{i}"], ["O", "B-CITY", "O", "O", "O"]) for i in range(40)]
    other = [(i, [f"o{i}"], ["O"]) for i in range(30)]
    kind = "row_id long, tokens array<string>, bio_labels array<string>"
    base_df, other_df = spark.createDataFrame(rows, kind), spark.createDataFrame(other, kind)
    got = generate.validation_set(base_df, other_df, 8, 6, 5, seed=3).collect()

    def first(df, seed, n, without=()):
        return [r.row_id for r in df.filter(~F.col("row_id").isin(list(without) or [-1])).orderBy(labels.draw(seed, F.col("row_id")), "row_id").limit(n).collect()]

    taken = first(base_df, 3, 8)
    pool = first(base_df, 4, 25, taken)
    assert Counter(r.part for r in got) == {"base": 8, "other": 6, **{label: 5 for label in generate.MISSING}}
    assert {tuple(r.tokens) for r in got if r.part == "base"} == {tuple(rows[i][1]) for i in taken}
    assert {tuple(r.tokens) for r in got if r.part == "other"} == {(f"o{i}",) for i in first(other_df, 3, 6)}
    used = []
    for r in got:
        if r.part in generate.MISSING:
            own = next(i for i in pool if rows[i][1][0] == r.tokens[0])
            added = len(r.tokens) - 5
            at = next(k for k in range(6) if list(r.tokens[:k]) == rows[own][1][:k] and list(r.tokens[k + added :]) == rows[own][1][k:])
            assert at == 3 and list(r.bio_labels[:at]) + list(r.bio_labels[at + added :]) == rows[own][2]
            assert f"B-{r.part}" in r.bio_labels[at : at + added]
            used.append(own)
    assert sorted(used) == sorted(pool)


def test_label_spans_of_a_batch_and_labels_stay_in_their_rows(spark):
    import random

    import pyarrow as pa

    from velatura.operators import rows as R

    def brute(row):
        out, before = [], None
        for i, x in enumerate(row or []):
            t = None if x is None or x == "O" else x[2:]
            if t is not None and (x.startswith("B-") or before != t):
                out.append({"type": t, "start": i, "end": i})
            if t is not None:
                out[-1]["end"] = i + 1
            before = t
        return out

    rng = random.Random(1)
    for _ in range(300):
        batch = [rng.choice([None, [], rng.choices(["O", "B-A", "I-A", "B-BB", "I-BB", None], k=rng.randrange(9))]) for _ in range(rng.randrange(12))]
        k = rng.randrange(len(batch) + 1)
        assert R.label_spans(pa.array(batch, pa.list_(pa.string())).slice(k)).to_pylist() == [brute(x) for x in batch[k:]], batch
    df = spark.createDataFrame([(1, "di 12 a", [("A", 0, 5, "di 12")]), (2, None, []), (3, "x", None)], "row_id int, text string, e array<struct<label:string,start:int,end:int,value:string>>")
    spans = labels.label_span_rows(df.withColumn("bio_labels", R.bio_labels_column(F.col("text"), F.col("e"))))
    assert [tuple(r) for r in spans.collect()] == [(1, "A", 0, 2)]
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()


def test_span_matches_groups_both_sides_once(spark):
    kind = "id int, start int, type string"
    gold, pred = spark.createDataFrame([(1, 0, "A"), (1, 0, "A"), (1, 4, "B"), (None, 2, "A")], kind), spark.createDataFrame([(1, 0, "A"), (2, 0, "B"), (None, 2, "A")], kind)
    m = evaluate.span_matches(gold, pred, ["id", "start"])
    assert {tuple(r) for r in m.collect()} == {("A", 1, 1, 1, 2), ("B", 0, 1, 1, 1)}  # a null key matches nothing
    assert "Join" not in m._jdf.queryExecution().executedPlan().toString()
