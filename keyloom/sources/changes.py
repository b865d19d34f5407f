"""The change feed: write commands as rows (seq, op, key, kind, fields), folded to the state of each key.

A string's text stands in the field *. Commands that name fields change only these: `hset` puts, `hdel` takes out, `hsetnx`
and `setnx` put where nothing stands, `append` adds to the text. `set`, `del` and their kin replace the whole key. A rename
names its new key in the field `to`; a key's state moves there at that point. A flush (its key is null) ends all keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored
from .graph import CHANGES

#: Commands that put a whole key, that put fields, that put where nothing stands, and that end a key.
WHOLE = ("set", "setex", "psetex", "getset", "mset", "msetnx", "put")
FIELDS = ("hset", "hmset", "xadd", "move")
ABSENT = ("setnx", "hsetnx")
ENDS = ("del", "unlink", "xdel")
RENAMES = ("rename", "renamenx")
FLUSHES = ("flushdb", "flushall")
_MAP = "map<string,string>"


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A streaming read of change files, at most so many a trigger."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def flushed(changes: DataFrame) -> int | None:
    """The number of the last flush."""
    return changes.where(F.col("op").isin(*FLUSHES)).agg(F.max("seq")).first()[0]


def _fold(rows: DataFrame) -> DataFrame:
    """(key, kind, deleted, fields) of commands without renames and flushes, by aggregations only.

    What stood before a key's last whole command, and before a field's last put or removal, is left out first."""
    last = rows.groupBy("key").agg(F.max(F.when(F.col("op").isin(*WHOLE, *ENDS), F.col("seq"))).alias("reset"), F.max_by("kind", "seq").alias("kind"))
    live = rows.drop("kind").join(last, "key").where("reset IS NULL OR seq >= reset").where(~F.col("op").isin(*ENDS))
    each = live.select("key", "seq", "op", F.explode("fields").alias("field", "value"))
    put, gone, absent, more = F.col("op").isin(*WHOLE, *FIELDS), F.col("op") == "hdel", F.col("op").isin(*ABSENT), F.col("op") == "append"
    firm = each.groupBy("key", "field").agg(F.max(F.when(put | gone, F.struct("seq", F.when(put, F.col("value")).alias("value")))).alias("firm"))
    after = each.where(absent | more).join(firm, ["key", "field"]).where("firm IS NULL OR seq > firm.seq")
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(more, F.struct("seq", "value")))), lambda x: x["value"]))
    later = after.groupBy("key", "field").agg(F.min_by("value", F.when(absent, F.col("seq"))).alias("given"), text.alias("text"))
    values = firm.join(later, ["key", "field"], "left").select("key", "field", F.coalesce(F.col("firm.value"), "given").alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    values = values.select("key", "field", F.when(F.col("own").isNotNull() | (F.col("text") != ""), F.concat(F.coalesce("own", F.lit("")), "text")).alias("value")).where("value IS NOT NULL")
    fields = values.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return last.select("key", "kind").join(fields, "key", "left").select("key", "kind", F.col("fields").isNull().alias("deleted"), "fields")


def _renamed(rows: DataFrame) -> DataFrame:
    """Commands without renames: each becomes the end of the old key and a put of its state under the new one. A round
    takes all renames that no earlier one of the same keys waits for."""
    while True:
        names = rows.where(F.col("op").isin(*RENAMES)).select("seq", F.col("key").alias("old"), F.col("fields")["to"].alias("new"))
        if names.limit(1).count() == 0:
            return rows
        ends = names.select("seq", F.explode(F.array("old", "new")).alias("key"))
        first = ends.groupBy("key").agg(F.min("seq").alias("low"))
        ready = stored(names.join(ends.join(first, "key").groupBy("seq").agg(F.min("low").alias("low")), "seq").where("low >= seq").select("seq", "old", "new"))
        moved = rows.join(ready.select(F.col("old").alias("key"), F.col("seq").alias("until")), "key").where("seq < until").drop("until")
        state = _fold(moved).where("NOT deleted")
        put = state.join(ready, F.col("key") == F.col("old")).select("seq", F.lit("put").alias("op"), F.col("new").alias("key"), "kind", "fields")
        end = ready.select("seq", F.lit("del").alias("op"), F.col("old").alias("key"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast(_MAP).alias("fields"))
        rest = rows.join(ready.select("seq"), "seq", "left_anti").join(ready.select(F.col("old").alias("key"), F.col("seq").alias("s")), "key", "left").where("s IS NULL OR seq > s")
        rows = stored(reduce(DataFrame.unionByName, [rest.select("seq", "op", "key", "kind", "fields"), put, end]))


def last_state(changes: DataFrame) -> DataFrame:
    """(key, kind, deleted, fields): what each key that the commands name has come to. Other commands change nothing."""
    known = (*WHOLE, *FIELDS, *ABSENT, *ENDS, *RENAMES, *FLUSHES, "hdel", "append")
    rows = changes.where(F.col("op").isin(*known)).select("seq", "op", "key", "kind", F.col("fields").cast(_MAP).alias("fields"))
    last = flushed(rows)
    if last is not None:
        over = rows.where((F.col("seq") < last) & F.col("key").isNotNull()).groupBy("key").agg(F.max_by("kind", "seq").alias("kind"))
        over = over.select(F.lit(last).cast("long").alias("seq"), F.lit("del").alias("op"), "key", "kind", F.lit(None).cast(_MAP).alias("fields"))
        rows = rows.where(F.col("seq") > last).unionByName(over)
    return _fold(_renamed(rows.where("key IS NOT NULL")))


def documents(state: DataFrame) -> DataFrame:
    """Documents to index: a string's text stands in the field *."""
    text = F.when(F.col("kind") == "S", F.col("fields")["*"])
    return state.where("NOT deleted").select("key", "kind", text.alias("text"), F.when(F.col("kind") != "S", F.col("fields")).alias("props"))
