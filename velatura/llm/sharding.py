"""Sharding by jump consistent hashing, with DataFrame functions only.

The hash (Lamping and Veach, 2014) needs no ring table: a key walks through the shard counts at which it would move,
and stops before the first one beyond the present count. Appending a shard therefore moves only the keys whose next
jump lands on it, an expected 1 / (n + 1) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velatura.llm.common import cut

#: Fixed value: the multiplier of the hash's linear congruential generator.
MULTIPLIER = 2862933555777941757
_LIMB, _TOP = (1 << 22) - 1, (1 << 20) - 1
#: A key takes about ln(n) jumps; the rare key that has not ended after so many is carried on to the end.
FIRST_JUMPS = 24


def _jump(state: Column, n_shards: int) -> Column:
    """One step, on a 64-bit state in limbs of 22, 22 and 20 bits: products stay below 2**63, also under ANSI rules."""
    m0, m1, m2 = MULTIPLIER & _LIMB, (MULTIPLIER >> 22) & _LIMB, MULTIPLIER >> 44
    a0, a1, a2 = state["a0"], state["a1"], state["a2"]
    t0 = a0 * F.lit(m0) + F.lit(1)
    t1 = a0 * F.lit(m1) + a1 * F.lit(m0) + F.shiftright(t0, 22)
    t2 = a0 * F.lit(m2) + a1 * F.lit(m1) + a2 * F.lit(m0) + F.shiftright(t1, 22)
    n0, n1, n2 = t0.bitwiseAND(F.lit(_LIMB)), t1.bitwiseAND(F.lit(_LIMB)), t2.bitwiseAND(F.lit(_TOP))
    high = F.shiftleft(n2, 11).bitwiseOR(F.shiftright(n1, 11))
    ahead = F.floor((state["next"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (high + F.lit(1)).cast("double")))
    moved = F.struct(state["next"].alias("at"), ahead.cast("long").alias("next"), n0.alias("a0"), n1.alias("a1"), n2.alias("a2"))
    return F.when(state["next"] >= F.lit(n_shards), state).otherwise(moved)


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard, 0 to n_shards - 1, of a key. Integers are hashed as they are, other types by xxhash64; null is 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"), key.bitwiseAND(F.lit(_LIMB)).alias("a0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(_LIMB)).alias("a1"), F.shiftrightunsigned(key, 44).alias("a2"),
    )
    steps = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: _jump(s, n_shards))
    done = steps(start, min(n_shards, FIRST_JUMPS))
    if n_shards > FIRST_JUMPS:
        done = F.when(done["next"] >= F.lit(n_shards), done).otherwise(steps(done, n_shards - FIRST_JUMPS))
    return done["at"].cast("int")


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, its place there, and its shard once another shard is appended.

    Law "key": id and shard count decide, whatever else the table holds. Returns doc_id, size (UTF-8 bytes plus 1), text_crc32,
    law, shard, slot (gapless from 0 in each shard, in the order of id, then checksum) and grown_shard.

    Defined results: a null text counts as empty; a null id is key 0; repeated rows each get a slot of their own, in any order among
    themselves; an empty table gives no rows; other columns are not looked at. Places come from counts by (shard, block of an
    id range), so no task ever numbers a whole shard, and ties of one id are spread by a row number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"),
    )
    ranged = narrow.repartitionByRange(*[F.col(c) for c in ("doc_id", "text_crc32", "size", "tie")])
    sharded = ranged.select(
        "*", jump_shard(F.col("doc_id"), n_shards).alias("shard"), jump_shard(F.col("doc_id"), n_shards + 1).alias("grown_shard"),
        F.spark_partition_id().alias("block"),
    )
    placed = cut(sharded)
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size", "tie")
    return (
        placed.join(offsets, ["shard", "block"])
        .withColumn("slot", (F.col("first") + F.row_number().over(inside) - 1).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
    )
