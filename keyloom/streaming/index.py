"""Upkeep of the index: all postings of a changed key are replaced at once, a deleted key loses its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import analyse
from ..scratch import stored
from ..sources import changes as feed
from ..sources.graph import POSTINGS

STATE = "key string, kind string, fields map<string,string>"


def replace_keys(postings: DataFrame, keys: DataFrame, new: DataFrame) -> DataFrame:
    """Begin, add and commit as one step: what the keys had goes, what is new comes."""
    return postings.join(keys.select("key").distinct(), "key", "left_anti").unionByName(new.select(*postings.columns))


def add(postings: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts single postings by (key, kind, field, token)."""
    return remove(postings, new).unionByName(new.select(*postings.columns))


def remove(postings: DataFrame, gone: DataFrame) -> DataFrame:
    at = ["key", "kind", "field", "token"]
    return postings.join(gone.select(*at).distinct(), at, "left_anti")


class Indexer:
    """The index as versions in a folder: a batch writes the next one and then moves on, so a batch that runs again
    after a failure starts from the version before it. `since` keeps the last batch that is in.

    The fields of each key are kept beside the postings, as commands of a batch may change some of a key's fields only."""

    def __init__(self, spark: SparkSession, postings: DataFrame | None = None, scoring: str = "weighted"):
        self.spark, self.scoring, self.since = spark, scoring, -1
        self.postings = postings if postings is not None else spark.createDataFrame([], POSTINGS)
        self.state = spark.createDataFrame([], STATE)
        self.before = (self.postings, self.state)
        self.query: StreamingQuery | None = None

    def apply(self, batch: DataFrame, number: int) -> None:
        postings, state = base = self.before if number <= self.since else (self.postings, self.state)
        if feed.flushed(batch) is not None:
            postings, state = postings.limit(0), state.limit(0)
        ends = F.when(F.col("op").isin(*feed.RENAMES), F.array("key", F.col("fields")["to"])).otherwise(F.array("key"))
        named = stored(batch.where("key IS NOT NULL").select(F.explode(ends).alias("key")).distinct())
        first = batch.agg(F.min("seq")).first()[0]
        held = state.join(named, "key", "left_semi").select(F.lit((first or 0) - 1).cast("long").alias("seq"), F.lit("put").alias("op"), "key", "kind", "fields")
        found = stored(feed.last_state(held.unionByName(batch.select("seq", "op", "key", "kind", "fields"))))
        new = analyse.postings(feed.documents(found), self.scoring)
        rest = state.join(found.select("key"), "key", "left_anti").unionByName(found.where("NOT deleted").select("key", "kind", "fields"))
        self.before = base
        self.postings, self.state = stored(replace_keys(postings, found, new)), stored(rest)
        self.since = number

    def on(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        self.query = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()
        return self.query

    def wait(self) -> None:
        self.query.processAllAvailable()

    def off(self) -> None:
        if self.query:
            self.query.stop()

    def status(self) -> dict:
        return {"active": bool(self.query and self.query.isActive), "batch": self.since, "progress": self.query.lastProgress if self.query else None}
