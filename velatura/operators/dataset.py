"""Relational operators of the data factory: de-duplication, caps, strata, profiles and draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velatura.functions.lineage import reliable
from velatura.operators.labels import draw


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows, with the name of their source; columns go by name, and missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in sources.items()])


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """A stable order that looks random."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)


def drop_exact(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The row with the smallest id of each text, null being the largest; of rows that are equal in both, one. Ids and digests tell which;
    a hot text is summed up before they shuffle."""
    digest = F.when(F.col(text_col).isNull(), F.lit("")).otherwise(F.sha2(F.col(text_col).cast("binary"), 256))
    packed = df.select(F.col(id_col).alias("id"), digest.alias("digest"), F.struct("*").alias("row"))
    index = packed.select("id", "digest")
    first = index.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id")).alias("k")).select(F.col("k.id").alias("own"), F.col("digest").alias("of"))
    kept = packed.join(first, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left_semi")
    return kept.dropDuplicates(["id", "digest"]).select("row.*")


def structure_key(template: Column, entities: Column) -> Column:
    """What an example is made of: its template and the labels in the order of their places."""
    ordered = F.transform(F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("s"), e["label"].alias("l")))), lambda x: x["l"])
    return F.concat_ws("#", template.cast("string"), F.array_join(ordered, "|"))


def cap_per_key(df: DataFrame, key: str | list[str], order: list[str | Column], cap: int = 25) -> DataFrame:
    """At most `cap` rows of each key, the first by order. A filter on the rank is taken before the shuffle as well, so a hot key
    sends no more than `cap` rows from each task."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= cap).drop("__rank")


def strata_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def tag_counts(df: DataFrame, tags_col: str = "tags") -> DataFrame:
    """tag, n_rows: rows that hold each tag."""
    return df.select(F.explode(F.array_distinct(tags_col)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"))


def stratified_sample(df: DataFrame, size: int, id_col: str, strata: list[str], tags_col: str = "tags", floors: dict[str, int] | None = None, default_floor: int = 40, seed: int = 0) -> DataFrame:
    """Rows of a subset: first a floor for each tag, the rarest first, then each stratum's share, then rows at random up to size.

    Later tags count what earlier ones took, so tags go one after the other (there are some twenty); each step ranks candidates
    by a hash of the id and keeps ids only. The subset is a list of ids, joined with the rows at the end.
    """
    index = reliable(df.select(F.col(id_col).alias("__id"), *strata, F.col(tags_col).alias("__tags"), draw(seed, F.col(id_col)).alias("__u")))
    total = index.count()
    size = min(size, total)
    tags = tag_counts(index, "__tags").orderBy("n_rows", "tag").collect()  # one row for each kind of entity
    spark = df.sparkSession
    chosen = spark.createDataFrame([], index.select("__id").schema)
    n_chosen = 0
    for t in tags:
        need = (floors or {}).get(t.tag, default_floor)
        own = index.filter(F.array_contains("__tags", t.tag))
        have = own.join(chosen, "__id", "left_semi").count()
        take = min(need - have, size - n_chosen)
        if take > 0:
            more = own.join(chosen, "__id", "left_anti").orderBy("__u", "__id").limit(take).select("__id")
            chosen = reliable(chosen.unionByName(more))
            n_chosen = chosen.count()
    taken = index.join(chosen, "__id", "left_semi").groupBy(*strata).agg(F.count(F.lit(1)).alias("__have"))
    quota = index.groupBy(*strata).agg(F.count(F.lit(1)).alias("__pool")).join(taken, strata, "left")
    quota = quota.select(*strata, "__pool", (F.bround(F.lit(size) * F.col("__pool") / F.lit(max(total, 1))) - F.coalesce("__have", F.lit(0))).alias("__deficit"))
    before = Window.orderBy(F.desc("__pool"), *strata).rowsBetween(Window.unboundedPreceding, -1)  # over strata, not rows
    quota = quota.withColumn("__deficit", F.greatest("__deficit", F.lit(0))).withColumn("__room", F.lit(size - n_chosen) - F.coalesce(F.sum("__deficit").over(before), F.lit(0)))
    rest = index.join(chosen, "__id", "left_anti").withColumn("__k", F.row_number().over(Window.partitionBy(*strata).orderBy("__u", "__id")))
    chosen = reliable(chosen.unionByName(rest.join(quota, strata).filter(F.col("__k") <= F.least("__deficit", "__room")).select("__id")))
    short = size - chosen.count()
    if short > 0:
        chosen = chosen.unionByName(index.join(chosen, "__id", "left_anti").orderBy("__u", "__id").limit(short).select("__id"))
    return df.join(chosen.withColumnRenamed("__id", id_col), id_col, "left_semi")


def quotas(df: DataFrame, size: int, strata: list[str]) -> DataFrame:
    """strata, pool, quota: each stratum's share of a subset, halves rounded to the even number."""
    total = Window.partitionBy()
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("pool"))
    return counts.withColumn("quota", F.bround(F.lit(float(size)) * F.col("pool") / F.sum("pool").over(total)).cast("bigint"))


def subset_report(pool: DataFrame, subset: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_subset, n_pool and both shares in per cent."""
    one = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = one(pool, "n_pool").join(one(subset, "n_subset"), keys, "full").fillna(0, ["n_pool", "n_subset"])
    share = lambda c: F.round(100.0 * F.col(c) / F.sum(c).over(Window.partitionBy()), 4)
    return both.select(*keys, "n_subset", "n_pool", share("n_subset").alias("subset_pct"), share("n_pool").alias("pool_pct"))


def most_common(df: DataFrame, col: str, k: int = 40) -> DataFrame:
    """The k most frequent values; ties go by value."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def group_examples(df: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """key, n_rows, and the first row's id and text."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(id_col).alias("first_id"), F.min_by(text_col, id_col).alias("first_text"))


def length_profile(df: DataFrame, length: Column, keys: list[str], over: tuple[int, ...] = (128, 256, 512)) -> DataFrame:
    """For each key: rows, longest, exact 50th, 90th, 95th and 99th percentile cut to whole numbers, and the share (%) over each limit."""
    counted = df.select(*keys, length.alias("n"))
    pct = [F.floor(F.percentile("n", p / 100)).cast("bigint").alias(f"p{p}") for p in (50, 90, 95, 99)]
    share = [F.round(100.0 * F.avg((F.col("n") > x).cast("int")), 4).alias(f"over_{x}") for x in over]
    return counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.max("n").cast("bigint").alias("longest"), *pct, *share)


def sample_rows(df: DataFrame, id_col: str, n: int = 8000, seed: int = 0) -> DataFrame:
    """n rows at random, the same on every run."""
    return df.orderBy(draw(seed, F.col(id_col)), id_col).limit(n)


def longest_rows(df: DataFrame, length: Column, id_col: str, n: int = 200) -> DataFrame:
    return df.orderBy(length.desc(), id_col).limit(n)


def absence(df: DataFrame, tags_col: str, tag: str, text_col: str, pattern: str) -> DataFrame:
    """One row: rows in all, rows with a tag, rows whose text has a keyword, and rows with the keyword but without the tag."""
    tagged, named = F.array_contains(tags_col, tag), F.coalesce(F.col(text_col).rlike(pattern), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(tagged).alias("n_tagged"), F.count_if(named).alias("n_keyword"), F.count_if(named & ~F.coalesce(tagged, F.lit(False))).alias("n_keyword_only"))


def latest_version(df: DataFrame, name_col: str, pattern: str = r"-v([0-9][0-9.]*)$", keys: tuple[str, ...] = ()) -> DataFrame:
    """The row (of each key) whose version, compared number by number, is the largest."""
    version = F.transform(F.filter(F.split(F.regexp_extract(name_col, pattern, 1), r"\."), lambda x: x != ""), lambda x: x.cast("int"))
    found = df.withColumn("version", version).filter(F.size("version") > 0)
    return found.groupBy(*keys).agg(F.max_by(name_col, "version").alias(name_col), F.array_join(F.max("version").cast("array<string>"), ".").alias("version"))


def by_length(df: DataFrame, length: Column, n: int | None = None) -> DataFrame:
    """Partitions of rows of like length, for readers that pad a batch to its longest row."""
    ranged = df.withColumn("__n", length)
    return (ranged.repartitionByRange(n, "__n") if n else ranged.repartitionByRange("__n")).sortWithinPartitions("__n").drop("__n")


#: Rows up to which a bank of templates, or a table of boosts, goes to all tasks; longer ones are joined. Parts that a long bank is summed in.
BANK_ROWS = 10_000
PARTS = 200


def _few(df: DataFrame, limit: int) -> bool:
    return df.limit(limit + 1).count() <= limit


def template_weights(templates: DataFrame, boosts: DataFrame, tags_col: str = "tags", id_col: str = "id", few_rows: int = BANK_ROWS) -> DataFrame:
    """id, weight: the largest boost of the tags that a template covers; 1 without any. boosts: tag, weight."""
    boosts = boosts.groupBy("tag").agg(F.max("weight").alias("weight"))
    each = templates.select(id_col, F.explode_outer(tags_col).alias("tag")).join(F.broadcast(boosts) if _few(boosts, few_rows) else boosts, "tag", "left")
    return each.groupBy(id_col).agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def weighted_choice(keys: DataFrame, weights: DataFrame, id_col: str = "id", u_col: str = "u", few_rows: int = BANK_ROWS) -> DataFrame:
    """keys with a template each: the draw u (0 to 1) falls into a template's share of the weights, templates in the order of ids.

    A short bank (id, weight) becomes a literal of the plan; a longer one is joined by the cells of a raster that its shares lie in.
    """
    bank = weights.select(F.col(id_col).alias("id"), "weight")
    if bank.isEmpty():
        raise ValueError("a bank has one template at least")
    if _few(bank, few_rows):
        rows = bank.orderBy("id").collect()
        total, ends, ids = 0.0, [], []
        for r in rows:
            total += r["weight"]
            ends.append(total)
            ids.append(r["id"])
        place = F.size(F.filter(F.lit(ends), lambda e: e <= F.col(u_col) * total))
        return keys.withColumn(id_col, F.get(F.lit(ids), F.least(place, F.lit(len(ids) - 1))))
    # Sums of weights over ranges of ids first, then inside each, so that no task sees the whole bank.
    bank = reliable(bank.repartitionByRange(PARTS, "id").withColumn("part", F.spark_partition_id()))
    sums = bank.groupBy("part").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each part
    begins, total, n = {}, 0.0, sum(r["n"] for r in sums)
    for r in sums:
        begins[r["part"]] = total
        total += r["weight"]
    after = dict(zip(begins, [*list(begins.values())[1:], total]))
    of = lambda m: F.element_at(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]), F.col("part"))
    before = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    shares = bank.withColumn("start", of(begins) + F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    shares = shares.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("part").orderBy("id")), of(after)))
    # Equal cells of the range of weights, as many as templates: a share lies in some of them, a draw in one.
    cell = lambda c: F.least(F.floor(c / total * n), F.lit(n - 1))
    cells = shares.filter("end > start").select("id", "start", "end", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
    names = {c: f"__{c}" for c in ("id", "start", "end", "cell")}
    cells = cells.select(*[F.col(c).alias(x) for c, x in names.items()])
    place = F.least(F.col(u_col) * total, F.lit(total * (1 - 2**-52)))
    inside = (cell(place) == F.col("__cell")) & (F.col("__start") <= place) & (place < F.col("__end"))
    joined = keys.join(cells, inside, "left")
    return joined.select(*[F.col(c) for c in keys.columns if c != id_col], F.col("__id").alias(id_col))


def parse_tags(value) -> list[str]:
    """Tags of an option: a list, or a text with commas or semicolons; upper case, each once."""
    if value is None:
        return []
    items = value.replace(";", ",").split(",") if isinstance(value, str) else [str(v) for v in value]
    return list(dict.fromkeys(t for t in (i.strip().upper() for i in items) if t))


def parse_flag(value, default: bool = True) -> bool:
    """A yes or no in English or Italian; anything else is the default."""
    if value is None or isinstance(value, bool):
        return default if value is None else value
    said = str(value).strip().lower()
    return True if said in {"1", "true", "yes", "y", "on", "si", "sì"} else False if said in {"0", "false", "no", "n", "off"} else default


def parse_boosts(items: list[str]) -> dict[str, float]:
    """TAG=WEIGHT options."""
    pairs = [i.split("=", 1) for i in items or []]
    if any(len(p) != 2 for p in pairs):
        raise ValueError("a boost is TAG=WEIGHT")
    return {k.strip().upper(): float(v) for k, v in pairs}
