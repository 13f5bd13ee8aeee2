"""Weighted rendezvous sharding with gapless slots. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT = 0x5EED


def score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the hash of key and shard: the least score wins the key.

    A shard wins in proportion to its weight, and a shard's scores don't depend on the others.
    """
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard of key, as an int; ties go to the smaller number."""
    best = F.array_min(F.array(*[F.struct(score(key, k, w).alias("s"), F.lit(k).alias("k")) for k, w in enumerate(weights)]))
    return best["k"]


def rendezvous_shards(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] | None = None,
    id_col: str = "doc_id", text_col: str = "text", cells: int = 1024, run: int = 65_536,
) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the shards' weights decide. grown (default: one more shard of
    weight 1) gives grown_shard; only rows that the new shards win move.

    Slots count from 0 in each shard, by (cell, doc_id, text_crc32, size), where the hash of key and text_crc32 chooses
    one of `cells` cells. So no task holds a shard, nor the rows of a key with many texts, such as null: rows of a cell are counted in one window, and the
    shards x cells offsets (a size that the parameters bound) are broadcast. Rows that agree in all
    these columns are counted before the shuffle and numbered together, in runs of `run` slots; the runs of those that have
    several are dealt out to tasks, so that equal rows are neither one array nor one task's. Choose cells so
    that rows / (shards x cells) fit a task.

    Null or empty text: size 1, CRC 0. Null id: all such rows share one shard, as nothing
    else may decide. Repeated rows: a slot each. No rows: no rows. Other columns are not read.
    """
    grown = [*weights, 1.0] if grown is None else grown
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        choose(key, weights).alias("shard"),
        choose(key, grown).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.crc32(data), F.lit(SALT).cast("long")), F.lit(cells)).cast("int").alias("cell"),
    )
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = same.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    offsets = offsets.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["shard", "cell"])
    placed = placed.withColumn("start", F.col("offset") + F.col("first"))
    runs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run)), lambda k: F.struct((F.col("start") + k * run).alias("low"), F.least(F.col("start") + (k + 1) * run, F.col("start") + F.col("n")).alias("end"))))
    columns = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard"]
    many = placed.where(F.col("n") > run).select(*columns, "grown_shard", runs.alias("r")).repartition("r")
    slots = lambda low, end: F.explode(F.sequence(low, end - 1)).alias("slot")
    few = placed.where(F.col("n") <= run).select(*columns, slots(F.col("start"), F.col("start") + F.col("n")), "grown_shard")
    return few.unionByName(many.select(*columns[:3], "law", "shard", slots(F.col("r.low"), F.col("r.end")), "grown_shard"))
