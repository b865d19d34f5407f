"""Write steps. Each gives a new snapshot of the graph; the old one stays as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import EDGES, Graph
from .relation import Relation

_MAP = "map<string,string>"


def add_vertices(graph: Graph, rows: DataFrame) -> Graph:
    """rows: (id, type, props); a vertex that exists stays unchanged."""
    new = rows.dropDuplicates(["id"]).join(graph.vertices.select("id"), "id", "left_anti")
    return graph.changed(vertices=graph.vertices.unionByName(new))


def add_vertex(graph: Graph, key: str, kind: str) -> Graph:
    return add_vertices(graph, graph.spark.createDataFrame([(key, kind, {"type": kind})], f"id string, type string, props {_MAP}"))


def _edges(rows: DataFrame, predicate: str, inverse: str | None, weight: Column) -> DataFrame:
    """rows: (subject, object) -> each edge and its twin. Without a name of its own, the twin's is `predicate` again."""
    other = inverse or predicate
    name = lambda p, a, b: F.concat_ws(":", F.lit(p), F.col(a), F.col(b))
    def one(p: str, q: str, a: str, b: str) -> DataFrame:
        props = F.create_map(F.lit("type"), F.lit(p), F.lit("half"), name(q, b, a), F.lit("edge"), name(p, a, b))
        return rows.select(name(p, a, b).alias("edge_id"), F.lit(p).alias("predicate"), F.col(a).alias("subject"), F.col(b).alias("object"), name(q, b, a).alias("inverse_id"), weight.cast("double").alias("weight"), props.alias("props"))
    return one(predicate, other, "subject", "object").unionByName(one(other, predicate, "object", "subject"))


def add_edges(graph: Graph, rows: DataFrame, predicate: str, inverse: str | None = None, weight: Column | None = None) -> tuple[Graph, Relation]:
    """For each (subject, object) pair, no self pairs; edges that exist stay unchanged."""
    new = _edges(rows.where("subject <> object").distinct(), predicate, inverse, weight if weight is not None else F.lit(1.0)).dropDuplicates(["edge_id"])
    fresh = new.join(graph.edges.select("edge_id"), "edge_id", "left_anti")
    after = graph.changed(edges=graph.edges.unionByName(fresh))
    return after, after.edge_relation(new.where(F.col("predicate") == predicate))


def pairs(subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """All subject-object pairs of two sets that a query names; the product is what the step stands for."""
    return subjects.select(F.col("key").alias("subject")).distinct().crossJoin(objects.select(F.col("key").alias("object")).distinct())


def edges_from_property(graph: Graph, rel: Relation, name: str) -> DataFrame:
    """(subject, object): keys joined with the vertex that their property names."""
    rows = rel.df.select(F.col("key").alias("subject"), rel.field(name).cast("string").alias("object")).where("object IS NOT NULL AND object <> ''")
    return rows.join(graph.vertices.select(F.col("id").alias("object")), "object", "left_semi").select("subject", "object")


def set_properties(graph: Graph, keys: DataFrame, values: dict[str, str | Column | None], source: DataFrame | None = None) -> Graph:
    """Sets or (None, '') removes properties of vertices or edges. Column values come from `source`, which has the key."""
    drop = [k for k, v in values.items() if v is None or isinstance(v, str) and v == ""]
    put = {k: v for k, v in values.items() if k not in drop}
    rows = (source if source is not None else keys).select("key", *[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(f"_v{i}") for i, v in enumerate(put.values())]).dropDuplicates(["key"])
    marks = rows.withColumn("_hit", F.lit(True))

    def change(df: DataFrame, id_col: str) -> DataFrame:
        old = F.coalesce("props", F.create_map().cast(_MAP))
        gone = [*drop, *put]
        kept = F.map_filter(old, lambda k, v: ~k.isin(gone))
        new = F.map_concat(kept, F.create_map(*[x for i, k in enumerate(put) for x in (F.lit(k), F.col(f"_v{i}"))]).cast(_MAP)) if put else kept
        joined = df.join(marks.withColumnRenamed("key", id_col), id_col, "left")
        cols = [F.when(F.col("_hit"), new).otherwise(F.col("props")).alias("props") if c == "props" else F.when(F.col("_hit"), F.lit(values["type"])).otherwise(F.col(c)).alias(c) if c == "type" and isinstance(values.get("type"), str) else F.col(c) for c in df.columns]
        return joined.select(*cols)

    return graph.changed(vertices=change(graph.vertices, "id"), edges=change(graph.edges, "edge_id"))


def drop(graph: Graph, keys: DataFrame) -> Graph:
    """Removes vertices with their edges and the twins of these, and edges with their twins."""
    keys = keys.select("key").distinct()
    gone = lambda df, c: df.join(keys.withColumnRenamed("key", c), c, "left_anti")
    edges = gone(gone(gone(gone(graph.edges, "subject"), "object"), "edge_id"), "inverse_id")
    return graph.changed(vertices=gone(graph.vertices, "id"), edges=edges.select(*graph.edges.columns))


def rename(graph: Graph, names: dict[str, str]) -> Graph:
    """Renames vertices, all at once, and with them the ids of their edges; a swap is one rename of two."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    new = lambda c: F.coalesce(F.try_element_at(table, c), c)
    vertices = graph.vertices.select(new(F.col("id")).alias("id"), "type", "props")
    touched = F.col("subject").isin(list(names)) | F.col("object").isin(list(names))
    s, o = new(F.col("subject")), new(F.col("object"))
    head = lambda c: F.substring_index(c, ":", 1)
    edge_id, inverse_id = F.concat_ws(":", F.col("predicate"), s, o), F.concat_ws(":", head(F.col("inverse_id")), o, s)
    props = F.transform_values("props", lambda k, v: F.when(k == "half", inverse_id).when(k == "edge", edge_id).otherwise(v))
    edges = graph.edges.select(F.when(touched, edge_id).otherwise(F.col("edge_id")).alias("edge_id"), "predicate", s.alias("subject"), o.alias("object"), F.when(touched, inverse_id).otherwise(F.col("inverse_id")).alias("inverse_id"), "weight", F.when(touched, props).otherwise(F.col("props")).alias("props"))
    return graph.changed(vertices=vertices, edges=edges.select(*[c.split()[0] for c in EDGES.split(", ")]))
