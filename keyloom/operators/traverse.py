"""Scans, one-hop traversals, triplets, denormalised rows and endpoints.

By default an edge is followed from either end and the result is taken by role: out(p) gives the objects of all edges
that touch the input. With strict=True a start vertex must be the edge's subject for out and its object for in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import glob
from ..sources.graph import Graph
from .relation import EDGE, TRIPLET, VERTEX, Relation

OUT, IN, BOTH = "object", "subject", "both"


def edges_of(graph: Graph, predicates: list[str]) -> DataFrame:
    """Edges whose predicate, or one above it in the type tree, globs one of the names; all without names.

    Plain names become an IN list on a literal column, which leaves only their branches of the union to scan."""
    if not predicates:
        return graph.edges
    plain = sorted({x for p in predicates if not any(c in p for c in "*?[") for x in graph.closure("E", p)})
    test = F.col("predicate").isin(plain) if plain else F.lit(False)
    for p in predicates:
        if any(c in p for c in "*?["):
            test = test | glob(F.col("predicate"), p)
    return graph.edges.where(test)


def _end_types(graph: Graph, predicates: list[str], side: str) -> tuple[str, ...] | None:
    names = [x for p in predicates for x in graph.closure("E", p) if x in graph.ends]
    if not predicates or any(c in p for p in predicates for c in "*?[") or not names:
        return None
    picked = {graph.ends[n][i] for n in names for i in ((1,) if side == OUT else (0,) if side == IN else (0, 1))}
    return tuple(sorted(picked))


def _touching(graph: Graph, rel: Relation, predicates: list[str]) -> list[str]:
    """The ends at which such edges can touch the input, as far as types tell."""
    own, ends = set(rel.types or ()), [e for e in ("subject", "object")]
    kinds = [_end_types(graph, predicates, side) for side in (IN, OUT)]
    known = own and all(kinds) and all(x in graph.ends for p in predicates for x in graph.closure("E", p))
    return [e for e, k in zip(ends, kinds) if own & set(k)] if known else ends


def incident(graph: Graph, rel: Relation, predicates: list[str], side: str, strict: bool = False) -> DataFrame:
    """Edges that touch the input, with `vertex`, the key that they touch. Both ends are tried only where types allow it."""
    edges, ends = edges_of(graph, predicates), _touching(graph, rel, predicates)
    if strict and side != BOTH:
        ends = ["subject" if side == OUT else "object"]
    touched = edges.withColumn("vertex", F.col(ends[0]) if len(ends) == 1 else F.explode(F.array_distinct(F.array("subject", "object"))))
    return touched.join(rel.df.select(F.col("key").alias("vertex")), "vertex")


def neighbours(graph: Graph, rel: Relation, predicates: list[str], side: str, strict: bool = False) -> Relation:
    """out, in and inout: distinct objects, subjects or both of the edges that touch the input."""
    rows = incident(graph, rel, predicates, side, strict)
    end = F.explode(F.array("subject", "object")) if side == BOTH else F.col(side)
    return Relation(rows.select(end.alias("key")).distinct(), VERTEX, _end_types(graph, predicates, side))


def having(graph: Graph, rel: Relation, predicates: list[str], side: str) -> Relation:
    """hasOut, hasIn, hasInout: input keys that are subject, object or either of such an edge."""
    edges = edges_of(graph, predicates)
    end = F.explode(F.array("subject", "object")) if side == BOTH else F.col("subject" if side == OUT else "object")
    return rel.with_df(rel.df.join(edges.select(end.alias("key")), "key", "left_semi"))


def triplets(graph: Graph, rel: Relation, predicates: list[str], side: str, by_vertex: bool = False, strict: bool = False) -> Relation:
    """Rows (key, subject, object, length, path) of one hop: vertex, edge, vertex in two halves of the weight's share."""
    rows = incident(graph, rel, predicates, side, strict).dropDuplicates(["edge_id"] if side != BOTH else ["edge_id", "vertex"])
    step = lambda key, inc: F.struct(F.col(key).alias("key"), inc.cast("double").alias("increment"))
    half = F.lit(0.5)
    path = F.array(step("subject", F.lit(0.0)), step("edge_id", half), step("object", half))
    key = F.col("object" if side == OUT else "subject") if side != BOTH or by_vertex else F.when(F.col("vertex") == F.col("subject"), F.col("object")).otherwise(F.col("subject"))
    return Relation(rows.select(key.alias("key"), "subject", "predicate", "object", F.lit(1.0).alias("length"), path.alias("path")).distinct(), TRIPLET)


def fuse(graph: Graph, rel: Relation, predicates: list[str], side: str) -> Relation:
    """One row for each edge: subject, predicate, object, and props with S_, O_ and P_ names."""
    rows = incident(graph, rel, predicates, side).drop("vertex").dropDuplicates(["edge_id"])
    out = rows
    for end, mark in (("subject", "S_"), ("object", "O_")):
        types = _end_types(graph, predicates, OUT if end == "object" else IN)
        v = graph.vertices.where(F.col("type").isin(list(types))) if types else graph.vertices
        named = F.transform_keys(F.map_filter("props", lambda k, x: x.isNotNull()), lambda k, x: F.concat(F.lit(mark), k))
        out = out.join(v.select(F.col("id").alias(end), named.alias(mark)), end)
    own = F.coalesce(F.transform_keys(F.map_filter("props", lambda k, x: x.isNotNull()), lambda k, x: F.concat(F.lit("P_"), k)), F.create_map().cast("map<string,string>"))
    key = F.sha2(F.concat_ws(":", F.lit("fuse"), F.col("edge_id")), 256)
    return Relation(out.select(key.alias("key"), "subject", "predicate", "object", F.map_concat("S_", "O_", own).alias("props")), "row")


def endpoints(graph: Graph, rel: Relation, side: str) -> Relation:
    """Distinct subjects or objects of an edge set; vertices pass unchanged."""
    if rel.kind != EDGE:
        return rel
    return Relation(rel.df.select(F.col(side).alias("key")).distinct(), VERTEX)


def _is_predicate(graph: Graph, name: str) -> bool:
    if name in graph.ends or ("E", name) in graph._children:
        return True
    test = glob(F.col("predicate"), name) if any(c in name for c in "*?[") else F.col("predicate") == name
    if graph.ends:
        names = graph.spark.createDataFrame([(n,) for n in graph.ends], "predicate string")
        return names.where(test).limit(1).count() > 0
    return graph.edges.where(test).limit(1).count() > 0


def edge_scan(graph: Graph, words: list[str]) -> Relation:
    """e(), e(p, q, ..) for predicates, and e(p, subject[, object]) where the second word is no predicate."""
    if len(words) >= 2 and not _is_predicate(graph, words[1]):
        rows = edges_of(graph, words[:1])
        for name, pattern in zip(("subject", "object"), words[1:3]):
            rows = rows.where(F.col(name) == pattern if not any(c in pattern for c in "*?[") else glob(F.col(name), pattern))
        return graph.edge_relation(rows)
    return graph.edge_relation(edges_of(graph, words))


def properties(rel: Relation, names: list[str]) -> list[Column]:
    """Output columns; a missing property is an empty string."""
    return [F.coalesce(rel.field(n).cast("string"), F.lit("")).alias(n) for n in names]
