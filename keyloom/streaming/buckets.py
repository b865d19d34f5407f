"""Time buckets of 15 minutes with running averages and shift registers of the last buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "15 minutes"


def bucket_averages(events: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value", width: str = BUCKET) -> DataFrame:
    """(key, bucket, x): the average of a key's values in each bucket; works on streams with a watermark too."""
    rows = events.groupBy(F.col(key).alias("key"), F.window(ts, width).alias("w")).agg(F.avg(value).alias("x"))
    return rows.select("key", F.col("w.start").alias("bucket"), "x")


def shift_register(buckets: DataFrame, slots: int = 4) -> DataFrame:
    """x_0 and the averages of the key's buckets before it."""
    order = Window.partitionBy("key").orderBy("bucket")
    return buckets.select("key", "bucket", F.col("x").alias("x_0"), *[F.lag("x", k).over(order).alias(f"x_{k}") for k in range(1, slots + 1)])


def stream_averages(events: DataFrame, late: str = "1 hour", **options) -> DataFrame:
    """Bucket averages of a stream; rows later than `late` are dropped."""
    return bucket_averages(events.withWatermark(options.get("ts", "ts"), late), **options)


def running_average(old: float, count: int, x: float) -> tuple[float, int]:
    """One probe more: (n avg + x) / (n + 1)."""
    return (count * old + x) / (count + 1), count + 1
