"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the records: a record's shard is the one whose seeded hash of (id, shard) is highest, and its bucket
inside the shard comes from a seeded hash of the whole record, so that buckets hold about `bucket_bytes` each, rows of one id included. Pass two gathers
each bucket, puts it in one order and runs Spark's `shuffle`, a Fisher-Yates shuffle with a seeded generator, numbers its rows from where the
shard's earlier buckets end, and writes it to the shard's folder. Only (shard, bucket, count) rows meet in a window.

The number of partitions follows the bytes and not the session's settings, and a bucket's partition its number: so the order, whose generator
Spark seeds by partition, is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest hash. A further shard takes rows only into itself: the others' hashes stay."""
    ranked = F.array(*(F.struct(F.xxhash64(key, F.lit(seed), F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(shards)))
    return F.array_max(ranked)["k"]


def shuffle_shards(records: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 20, bucket_bytes: int = 8 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """All records in random order over `shards` shards: (record, shard, slot, grown_shard).

    `record` is a struct of all input columns, whatever their names; slot is gapless from 0 in each shard; grown_shard is the shard
    under shards + 1. The law is `key`: the key and the number of shards alone decide. Rows that repeat a key share a shard, lie in its buckets by their
    other columns (columns that are or hold maps by their text), and each get a slot; rows that are equal in all columns lie in one bucket, in which they can't be told apart. A null key is a key like
    any other, a null text counts no bytes, an empty table gives an empty result. Equal tables give equal orders in every run.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 16
    total = records.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    columns = [F.col(f"`{c}`") for c in records.columns]
    hashed = [c.cast("string") if "map<" in kind else c for c, (_, kind) in zip(columns, records.dtypes, strict=True)]
    bucket = F.pmod(F.xxhash64(*hashed, F.lit(seed + 1)), F.lit(buckets)).cast("int")
    shard = shard_of(F.col(f"`{key}`"), shards, seed)
    place = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        records.select(shard.alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(place), F.lit(0)).alias("base"))
    )
    tie = F.xxhash64(*hashed, F.lit(seed + 2))
    entry = F.struct(F.col(f"`{key}`").alias("key"), tie.alias("tie"), F.struct(*columns).alias("record"))
    gathered = (
        records.select(shard.alias("shard"), bucket.alias("bucket"), entry.alias("entry"))
        .repartition(max(1, -(-total // task_bytes)), "shard", "bucket")
        .groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("entry"), _by_key_and_tie).alias("entries"))
        .sortWithinPartitions("shard", "bucket")
        .select("shard", "bucket", F.shuffle("entries", seed).alias("entries"))
    )
    drawn = gathered.join(bases, ["shard", "bucket"]).select("shard", "base", F.posexplode("entries").alias("at", "entry"))
    grown = shard_of(F.col("entry.key"), shards + 1, seed)
    return drawn.select(F.col("entry.record").alias("record"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), grown.alias("grown_shard"))


def _by_key_and_tie(a: Column, b: Column) -> Column:
    """Null keys first; rows with equal keys by the hash of all their columns."""
    order = F.when(a["key"].isNull() & b["key"].isNotNull(), -1).when(a["key"].isNotNull() & b["key"].isNull(), 1)
    order = order.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1)
    return order.when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0)


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Writes one folder for each shard, a file for each of its buckets or few of them, and reads them back."""
    shuffled.write.partitionBy("shard").parquet(path)
    schema = shuffled.select(*(c for c in shuffled.columns if c != "shard"), "shard").schema
    return shuffled.sparkSession.read.schema(schema).parquet(path)
