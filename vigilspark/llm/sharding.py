"""Sharding by jump consistent hashing, in DataFrame functions only.

The key of a row is the first 64 bits of the MD5 of its id's text. Jump hashing walks
the shard counts at which the key would move, so the shard needs no ring or table, and
one more shard takes rows only into itself: a row's shard among n + 1 is either the new
one or the one it has among n. Both come from one walk. Products modulo 2^64 are formed
from 32-bit halves, which no arithmetic mode of Spark lets overflow.

A row's slot is its place in its shard by (doc_id, crc of the text, size). Narrow rows are
range-partitioned by shard and that order, so a shard spans many tasks; a row number within
the partition and the counts of the partitions before give the slot.

Defined results: a null text has no bytes (size 1, crc 0); ids are hashed as text, a null
one as the empty text, and come first in their shard; rows repeated in full have slots of
their own, and which has which cannot be told; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, table, written

SHARDS = 16
#: Multiplier of the walk's generator, 2862933555777941757, in 32-bit halves (fixed values of the published method).
HIGH, LOW = 0x27BB2EE6, 0x87B0B0FD
#: Steps in the first part of a walk, which has about ln(shards) + 1; a longer one goes on for as many as there are shards.
STEPS = 64
_MASK = (1 << 32) - 1


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * multiplier + 1 modulo 2^64, in halves that are not negative."""
    low, mid = lo * F.lit(LOW & 0xFFFF) + 1, lo * F.lit(LOW >> 16)
    t = low + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(t, 32) + F.shiftright(mid, 16)
    cross = hi * F.lit(LOW & 0xFFFF) + F.shiftleft((hi * F.lit(LOW >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (cross + lo * F.lit(HIGH) + carry).bitwiseAND(F.lit(_MASK)), t.bitwiseAND(F.lit(_MASK))


def jump_hash(hi: Column, lo: Column, shards: int) -> Column:
    """Struct (shard, grown) of a 64-bit key in halves: its shard among `shards`, and among one more."""
    if shards < 1:
        raise ValueError("shards begin at 1")
    zero, none = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    state = F.struct(none.alias("b"), zero.alias("j"), hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))

    def step(s: Column, _: Column) -> Column:
        h, low = _next(s["hi"], s["lo"])
        far = ((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + 1).cast("double"))).cast("bigint")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), far.alias("j"), h.alias("hi"), low.alias("lo")))

    def result(s: Column) -> Column:
        return F.struct(s["b"].cast("int").alias("shard"), F.when(s["j"] == shards, s["j"]).otherwise(s["b"]).cast("int").alias("grown"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), state, step)
    if shards > STEPS:  # the few keys that are still on their way
        walked = F.get(F.transform(F.array(walked), lambda s: F.when(s["j"] >= shards, s).otherwise(F.aggregate(F.sequence(F.lit(STEPS + 1), F.lit(shards)), s, step))), F.lit(0))
    return F.get(F.transform(F.array(walked), result), F.lit(0))


def key_of(value: Column) -> tuple[Column, Column]:
    """Halves of a value's 64-bit key."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return half(1), half(9)


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """All columns of docs with shard and grown_shard (its shard once one more is appended); columns of these names are replaced."""
    docs = docs.drop("shard", "grown_shard")
    at = jump_hash(*key_of(F.col(key)), shards)
    return docs.withColumn("_at", at).withColumns({"shard": F.col("_at.shard"), "grown_shard": F.col("_at.grown")}).drop("_at")


def slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """rows with slot: the place from 0 within the shard by `order`. Rows are ranged over tasks by shard and order; ties are split too."""
    # two passes over the rows sample and deal them: they come from a table, so that texts are read once
    kept = written(rows, "sharding")
    by = [shard, *order, "_row"]
    dealt = kept.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "sharding")
    drop_written(kept)
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(shard, part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition of the shuffle and one more for each shard that begins within a partition
    starts = counts.select(shard, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    both = placed.withColumn("_part", part).join(F.broadcast(starts), [shard, "_part"])
    return both.withColumn("slot", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "slot")


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = slots(sharded(narrow, shards), "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1, key: str = "doc_id") -> None:
    """Write docs as Parquet in a folder per shard (shard=0, ...); `files` tasks share a shard, by a second hash of the row's key."""
    dealt = sharded(docs, shards, key).drop("grown_shard").withColumn("_file", F.pmod(F.xxhash64(F.col(key), F.monotonically_increasing_id()), F.lit(files)))
    dealt.repartition(shards * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)


def op12_shards(spark, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))
