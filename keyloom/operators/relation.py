"""Keysets: what queries compute with.

A relation is a lazy DataFrame with a key column. Vertex and edge relations carry either the typed columns of one view,
or a props map, or the key alone; properties are joined on when a step asks for them, and only those it asks for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

VERTEX, EDGE, POSTING, TRIPLET, GROUP, ROW = "vertex", "edge", "posting", "triplet", "group", "row"


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    kind: str = VERTEX
    types: tuple[str, ...] | None = None  # the vertex types that keys can have, where known

    def has_column(self, name: str) -> bool:
        return name in self.df.columns

    def loaded(self, name: str) -> bool:
        return self.has_column("props") or self.has_column(name)

    def field(self, name: str) -> Column:
        if self.has_column(name) and name not in ("props", "score"):
            return F.col(f"`{name}`")
        if self.has_column("props"):
            return F.col("props")[name]
        return F.lit(None).cast("string")

    def is_numeric(self, name: str) -> bool:
        return self.has_column(name) and isinstance(self.df.schema[name].dataType, NumericType)

    def keys(self) -> DataFrame:
        return self.df.select("key")

    def with_df(self, df: DataFrame, **changes) -> Relation:
        return replace(self, df=df, **changes)


def empty(spark, schema: str = "key string") -> DataFrame:
    return spark.createDataFrame([], schema)
