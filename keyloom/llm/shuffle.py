"""Operator 7: two-pass external shuffle, and shards dealt from it.

Pass 1 scatters records uniformly into buckets of about BUCKET_BYTES by a seeded hash of id and text. Records alike in
both that together take over an eighth of a bucket are dealt by their places in their partitions instead, so that a
record that fills a third of the table fills no bucket. Pass 2 takes one bucket at a time, orders it by content, applies
a seeded Fisher-Yates shuffle and writes it. The buckets in turn are one random order of all records; record p of it
goes to shard p mod n, so that the shards' counts differ by one at most (`rows`).

The order depends on the records and the seed; with records dealt by place also on how they are partitioned, which a
task that runs again does not change. Nulls: a null text is empty, with size 1; a null id is an id like any other. An
empty table gives no rows. Columns of any name are carried along in a struct; only ids, texts and hashes decide.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flagged, nullable, packed, scratch_path, stored

BUCKET_BYTES = 16 << 20
SHARDS = 8
_GROUP = 1024


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation by Fisher and Yates' exchanges (numpy's Generator.shuffle), from a seed."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64(seed)).shuffle(order)
    return order


def external_shuffle(docs: DataFrame, path: str, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shuffled records to `path` as Parquet: row (a struct of all columns), bucket, place, size and crc."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    text = F.col(text_col).cast("string")
    held = packed(docs, text=text, id=F.col(id_col), key=F.xxhash64(F.lit(seed), F.col(id_col), text, F.col(id_col).isNull(), text.isNull()))
    # Records that are many: dealt evenly over all buckets by a running number, whatever row comes to which.
    share = max(64, bucket_bytes // 8)
    many = stored(held.groupBy("key").agg(F.count("*").alias("n"), F.max(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("one")).where((F.col("n") > 1) & (F.col("n") * F.col("one") > share)).select(F.col("key").alias("h")))
    hot = many.limit(1).count() > 0
    home = F.pmod("key", F.lit(buckets)).cast("int")
    if hot:
        spread = F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33) * 7919, F.lit(buckets)).cast("int")
        held = flagged(held, "key", many).withColumn("bucket", F.when(F.col("_maybe"), spread).otherwise(home)).drop("_maybe")
    else:
        held = held.withColumn("bucket", home)
    held = held.withColumn("key", F.xxhash64(F.lit(seed + 1), "key")).drop("id")
    types = f"row {docs.schema.simpleString()}, bucket int, place long, size long, crc long"

    def bucket(tab: pa.Table) -> pa.Table:
        """Content order first: the shuffle of a bucket must not depend on the order in which its records arrived."""
        tab = tab.combine_chunks()
        texts = tab.column("text").cast(pa.large_binary()).to_pylist()
        sizes = [len(x or b"") for x in texts]
        crc = np.array([zlib.crc32(x or b"") for x in texts], np.int64)
        n, number = len(texts), tab.column("bucket")[0].as_py()
        order = np.lexsort((crc, np.array(sizes), tab.column("key").to_numpy()))
        order = order[fisher_yates(n, seed * 1_000_003 + number)]
        take = pa.array(order)
        rows = tab.column("_row").take(take)
        return pa.table({"row": rows.cast(nullable(rows.type)), "bucket": tab.column("bucket").take(take), "place": pa.array(np.arange(n)), "size": pa.array(np.array(sizes, np.int64)[order] + 1), "crc": pa.array(crc[order])})

    held.groupBy("bucket").applyInArrow(bucket, types).write.parquet(path)
    return spark.read.parquet(path)


def positions(shuffled: DataFrame) -> DataFrame:
    """Adds p, the record's place in the whole order. Bucket counts are summed in groups, so no task holds all of them."""
    counts = stored(shuffled.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("g", F.expr(f"bucket div {_GROUP}")))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("g").agg(F.sum("n").alias("n")).select("g", before(Window.orderBy("g")).alias("up"))
    starts = counts.withColumn("own", before(Window.partitionBy("g").orderBy("bucket"))).join(groups, "g").select("bucket", (F.col("own") + F.col("up")).alias("before"))
    return shuffled.join(starts, "bucket").withColumn("p", F.col("before") + F.col("place")).drop("before")


def shards(docs: DataFrame, n: int = SHARDS, seed: int = 0, path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; the records lie shuffled under `path`."""
    path = path or scratch_path(docs.sparkSession, "shuffle")
    places = positions(external_shuffle(docs, path, seed, bucket_bytes))
    return places.select("row.doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.expr(f"cast(p % {n} as int)").alias("shard"), F.expr(f"p div {n}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
