"""Graphs as DataFrames, and the driver's tables seen as one.

vertices  : id, type, props MAP<STRING,STRING>           (a null property is a missing one)
edges     : edge_id, predicate, subject, object, inverse_id, weight, props
type_tree : kind 'V'|'E', super, sub                     (schema-sized)
Typed views keep a type's columns as they are stored, so that filters and column selection reach the scan.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import EDGE, VERTEX, Relation, empty

VERTICES = "id string, type string, props map<string,string>"
EDGES = "edge_id string, predicate string, subject string, object string, inverse_id string, weight double, props map<string,string>"
TYPE_TREE = "kind string, super string, sub string"
DOCUMENTS = "key string, kind string, text string, props map<string,string>"
POSTINGS = "key string, kind string, field string, token string, score double"
CHANGES = "seq bigint, op string, key string, kind string, fields map<string,string>"
#: A type tree is a schema and not data; one with more rows than this isn't read by the planner.
MAX_TREE = 100_000


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def edge_rows(df: DataFrame, predicate: str, inverse: str, subject: Column, object: Column, weight: Column | None = None) -> DataFrame:
    """Both facts of a triplet type: each edge and its twin in the other direction."""
    base = df.select(subject.alias("s"), object.alias("o"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"))
    name = lambda p, a, b: F.concat_ws(":", F.lit(p), a, b)
    one = lambda p, q, a, b: base.select(name(p, F.col(a), F.col(b)).alias("edge_id"), F.lit(p).alias("predicate"), F.col(a).alias("subject"), F.col(b).alias("object"), name(q, F.col(b), F.col(a)).alias("inverse_id"), "weight", F.lit(None).cast("map<string,string>").alias("props"))
    return one(predicate, inverse, "s", "o").unionByName(one(inverse, predicate, "o", "s"))


@dataclass
class Graph:
    spark: SparkSession
    vertices: DataFrame
    edges: DataFrame
    type_tree: DataFrame | None = None
    documents: DataFrame | None = None
    postings: DataFrame | None = None
    typed: dict[str, DataFrame] = field(default_factory=dict)  # by type: key, type and stored columns
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)  # by predicate: types of subject and object
    twins: dict[str, str] = field(default_factory=dict)  # by predicate: the one of its twins, where each edge has one

    @classmethod
    def of(cls, spark: SparkSession, vertices: DataFrame | None = None, edges: DataFrame | None = None, **rest) -> Graph:
        return cls(spark, vertices if vertices is not None else empty(spark, VERTICES), edges if edges is not None else empty(spark, EDGES), **rest)

    def changed(self, **parts) -> Graph:
        """A new snapshot. Typed views and twins describe the stored tables, so they end with the first write."""
        if "vertices" in parts or "edges" in parts:
            parts = {"typed": {}, "ends": {}, "twins": {}} | parts
        return replace(self, **parts)

    @cached_property
    def _children(self) -> dict[tuple[str, str], set[str]]:
        if self.type_tree is None:
            return {}
        rows = self.type_tree.limit(MAX_TREE + 1).collect()
        if len(rows) > MAX_TREE:
            raise ValueError(f"a type tree has at most {MAX_TREE} rows")
        out: dict[tuple[str, str], set[str]] = {}
        for r in rows:
            out.setdefault((r["kind"], r["super"]), set()).add(r["sub"])
        return out

    def closure(self, kind: str, name: str) -> list[str]:
        """The type or predicate and all below it; a cycle ends where it closes."""
        found, front = {name}, [name]
        while front:
            for sub in self._children.get((kind, front.pop()), ()):
                if sub not in found:
                    found.add(sub)
                    front.append(sub)
        return sorted(found)

    def is_type(self, name: str) -> bool:
        return name in self.typed or ("V", name) in self._children

    def vertex_relation(self, types: list[str] | None = None) -> Relation:
        """All vertices, or those of some types; a single typed one keeps its columns."""
        if types and len(types) == 1 and types[0] in self.typed:
            return Relation(self.typed[types[0]], VERTEX, tuple(types))
        rows = self.vertices.withColumnRenamed("id", "key")
        return Relation(rows.where(F.col("type").isin(types)) if types else rows, VERTEX, tuple(types) if types else None)

    def edge_relation(self, rows: DataFrame) -> Relation:
        return Relation(rows.withColumnRenamed("edge_id", "key"), EDGE)

    def load(self, rel: Relation, names: list[str]) -> Relation:
        """Joins on the asked-for properties of bare keys."""
        missing = [n for n in names if not rel.loaded(n)]
        if not missing or rel.kind not in (VERTEX, EDGE):
            return rel
        if rel.types and len(rel.types) == 1 and rel.types[0] in self.typed:
            view = self.typed[rel.types[0]]
            more = [n for n in missing if n in view.columns and n not in rel.df.columns]
            return rel.with_df(rel.df.join(view.select("key", *more), "key")) if more else rel
        if rel.kind == EDGE:
            source = self.edges.select(F.col("edge_id").alias("key"), "props")
        else:
            source = self.vertices if not rel.types else self.vertices.where(F.col("type").isin(list(rel.types)))
            source = source.select(F.col("id").alias("key"), *([] if rel.has_column("type") else ["type"]), *[F.col("props")[n].alias(n) for n in missing if n != "type"])
        return rel.with_df(rel.df.join(source, "key"))


def _view(df: DataFrame, kind: str, key: str) -> DataFrame:
    return df.select(F.concat(F.lit(kind + "/"), F.col(key).cast("string")).alias("key"), F.lit(kind).alias("type"), *df.columns)


def driver_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Region, nation, customer, supplier, part and order as vertices, and six predicates with their inverses."""
    read = lambda t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet"))
    region, nation, customer, supplier, part, orders, line = map(read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    typed = {"region": _view(region, "region", "r_regionkey"), "nation": _view(nation, "nation", "n_nationkey"), "customer": _view(customer, "customer", "c_custkey"), "supplier": _view(supplier, "supplier", "s_suppkey"), "part": _view(part, "part", "p_partkey"), "order": _view(orders, "order", "o_orderkey")}
    props = lambda df: F.create_map(*[x for c in df.columns if c not in ("key", "type") for x in (F.lit(c), F.col(c).cast("string"))])
    vertices = union([df.select(F.col("key").alias("id"), "type", props(df).alias("props")) for df in typed.values()])
    at = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    contains = line.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    supplied = line.groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("w"))
    triplets = [
        (nation, "in_region", "has_nation", at("nation", "n_nationkey"), at("region", "n_regionkey"), None),
        (customer, "lives_in", "has_customer", at("customer", "c_custkey"), at("nation", "c_nationkey"), None),
        (supplier, "based_in", "has_supplier", at("supplier", "s_suppkey"), at("nation", "s_nationkey"), None),
        (orders, "placed_by", "placed", at("order", "o_orderkey"), at("customer", "o_custkey"), None),
        (contains, "contains", "contained_in", at("order", "l_orderkey"), at("part", "l_partkey"), F.col("w")),
        (supplied, "supplied_by", "supplies", at("part", "l_partkey"), at("supplier", "l_suppkey"), F.col("w")),
    ]
    types = {"in_region": ("nation", "region"), "lives_in": ("customer", "nation"), "based_in": ("supplier", "nation"), "placed_by": ("order", "customer"), "contains": ("order", "part"), "supplied_by": ("part", "supplier")}
    inverse = {t[1]: t[2] for t in triplets}
    types |= {inverse[p]: ends[::-1] for p, ends in types.items()}
    tree = [("V", "party", "customer"), ("V", "party", "supplier"), ("V", "place", "region"), ("V", "place", "nation"), ("V", "thing", "part"), ("V", "thing", "order"), ("E", "located", "lives_in"), ("E", "located", "based_in")]
    docs = read("documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.lit("S").alias("kind"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("props"))
    return Graph(spark, vertices, union([edge_rows(*t) for t in triplets]), spark.createDataFrame(tree, TYPE_TREE), docs, None, typed, types, inverse | {q: p for p, q in inverse.items()})
