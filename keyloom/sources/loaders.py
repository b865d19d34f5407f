"""Loaders: delimited text and graph JSON; writers: rows as JSON, text or strings, and subgraphs as JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored
from .graph import Graph

SEPARATORS = {"TAB": "\t", "COMMA": ",", "SEMICOLON": ";"}
_LINES = {"CRLF": None, "LF": None, "BAR": "|"}
_CLEAN_HEADER = re.compile(r"[()./+\-*%`]")


def load_text(spark: SparkSession, path: str, separator: str = "TAB", lines: str = "CRLF", key: str | int = 0, kind: str | None = None) -> DataFrame:
    """(key, type, props) from a delimited file: a header row, the key column, non-empty cells as properties.

    Quotes around a cell and blanks at its end go; header characters that no name can have become _."""
    reader = spark.read.option("header", True).option("sep", SEPARATORS.get(separator, separator)).option("quote", '"').option("ignoreTrailingWhiteSpace", True).option("inferSchema", False)
    if _LINES.get(lines, lines):
        reader = reader.option("lineSep", _LINES.get(lines, lines))
    raw = reader.csv(path)
    names = [_CLEAN_HEADER.sub("_", c) for c in raw.columns]
    raw = raw.toDF(*names)
    key_name = names[key] if isinstance(key, int) else key
    type_name = kind or ("type" if "type" in names else None)
    cell = lambda c: F.nullif(F.rtrim(F.col(f"`{c}`")), F.lit(""))
    props = F.create_map(*[x for c in names if c != key_name for x in (F.lit(c), cell(c))])
    return raw.select(cell(key_name).alias("key"), (cell(type_name) if type_name else F.lit(None).cast("string")).alias("type"), F.map_filter(props, lambda k, v: v.isNotNull()).alias("props")).where("key IS NOT NULL")


def as_documents(rows: DataFrame, mode: str = "HASH") -> DataFrame:
    """Loaded rows in the shape they are stored in: a hash of fields, or one text made of them."""
    text: dict[str, Column] = {
        "JSON": F.to_json("props"),
        "TEXT": F.concat(F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat_ws(":", e["key"], e["value"])), ";"), F.lit(";")),
        "STRING": F.concat(F.array_join(F.map_values("props"), " "), F.lit(" ")),
    }
    if mode == "HASH":
        return rows.select("key", F.lit("H").alias("kind"), F.lit(None).cast("string").alias("text"), "props")
    return rows.select("key", F.lit("S").alias("kind"), text[mode].alias("text"), F.lit(None).cast("map<string,string>").alias("props"))


_RESERVED = ("iri", "type", "subject", "predicate", "object", "inverse_iri", "inverse", "weight", "tertiary")


def load_graph_json(spark: SparkSession, path: str) -> Graph:
    """Vertices and edges from a list of JSON objects, one list or one object a line.

    {iri, type, ..} is a vertex. {subject, predicate, object} is an edge; its ends are ids, vertices or further edges,
    the predicate a name or an object with type, inverse, weight and properties. Nesting is taken apart to its end."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("j"))
    items = whole.select(F.explode(F.when(F.ltrim("j").startswith("["), F.from_json("j", "array<string>")).otherwise(F.filter(F.split("j", "\n"), lambda x: F.trim(x) != ""))).alias("j"))
    entry = lambda d: d.select(F.from_json("j", "map<string,string>").alias("m")).where("m IS NOT NULL")
    level, found = stored(entry(items)), None
    while True:
        found = level if found is None else found.unionByName(level)
        nested = level.select(F.explode(F.array(F.col("m")["subject"], F.col("m")["object"])).alias("j")).where("ltrim(j) LIKE '{%'")
        level = stored(entry(nested))
        if level.limit(1).count() == 0:
            break
    is_edge = F.map_contains_key("m", F.lit("subject")) & F.map_contains_key("m", F.lit("object"))
    own = F.map_filter("m", lambda k, v: ~k.isin(*_RESERVED) & v.isNotNull())
    vertices = found.where(~is_edge & F.map_contains_key("m", F.lit("iri"))).select(F.col("m")["iri"].alias("id"), F.col("m")["type"].alias("type"), own.alias("props")).dropDuplicates(["id"])

    def end(c: Column) -> Column:
        obj = F.from_json(c, "map<string,string>")
        inner = F.concat_ws(":", F.coalesce(F.get_json_object(obj["predicate"], "$.type"), obj["predicate"]), F.coalesce(F.get_json_object(obj["subject"], "$.iri"), obj["subject"]), F.coalesce(F.get_json_object(obj["object"], "$.iri"), obj["object"]))
        return F.when(F.ltrim(c).startswith("{"), F.coalesce(obj["iri"], F.when(obj["subject"].isNotNull(), inner))).otherwise(c)

    p = F.col("m")["predicate"]
    pj = F.when(F.ltrim(p).startswith("{"), F.from_json(p, "map<string,string>"))
    rows = found.where(is_edge).select(end(F.col("m")["subject"]).alias("s"), end(F.col("m")["object"]).alias("o"), F.coalesce(pj["type"], p).alias("p"), F.coalesce(pj["inverse"], F.col("m")["inverse"], pj["type"], p).alias("q"), F.coalesce(pj["weight"], F.col("m")["weight"], F.lit("1")).cast("double").alias("weight"), F.coalesce(F.map_filter(pj, lambda k, v: ~k.isin(*_RESERVED) & v.isNotNull()), own).alias("props"))
    name = lambda a, b, c: F.concat_ws(":", a, b, c)
    one = lambda p, q, a, b: rows.select(name(F.col(p), F.col(a), F.col(b)).alias("edge_id"), F.col(p).alias("predicate"), F.col(a).alias("subject"), F.col(b).alias("object"), name(F.col(q), F.col(b), F.col(a)).alias("inverse_id"), "weight", "props")
    edges = one("p", "q", "s", "o").unionByName(one("q", "p", "o", "s")).dropDuplicates(["edge_id"])
    bare = edges.select(F.col("subject").alias("id")).distinct().join(vertices.select("id"), "id", "left_anti").where("instr(id, ':') = 0")
    vertices = vertices.unionByName(bare.select("id", F.lit(None).cast("string").alias("type"), F.create_map().cast("map<string,string>").alias("props")))
    return Graph.of(spark, stored(vertices), stored(edges))


def _within(graph: Graph, key: str, depth: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """(entities, triplets) as JSON, a row each: what lies within `depth` hops of a key."""
    reached = stored(graph.vertices.where(F.col("id") == key).select(F.col("id").alias("key")))
    front = reached
    kinds = near = {r["type"] for r in graph.vertices.where(F.col("id") == key).select("type").distinct().limit(1000).collect()}
    for _ in range(depth):
        edges = graph.edges
        if graph.ends:  # edges that can touch such vertices, as far as types tell; the others are not read
            names = [p for p, ends in graph.ends.items() if near & set(ends)]
            edges, near = edges.where(F.col("predicate").isin(names)), {x for p in names for x in graph.ends[p]}
            kinds = kinds | near
        half = edges.select(F.col("subject").alias("a"), F.col("object").alias("b"))
        half = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b")))
        front = stored(front.join(half, front.key == half.a).select(F.col("b").alias("key")).distinct().join(reached, "key", "left_anti"))
        if front.limit(1).count() == 0:
            break
        reached = stored(reached.unionByName(front))
        if most is not None and reached.limit(most + 1).count() > most:
            break
    vertices, edges = graph.vertices, graph.edges
    if graph.ends:
        vertices = vertices.where(F.col("type").isin(sorted(kinds)))
        edges = edges.where(F.col("predicate").isin([p for p, ends in graph.ends.items() if set(ends) <= kinds]))
    inside = vertices.join(reached.withColumnRenamed("key", "id"), "id")
    entity = F.struct(F.col("id").alias("iri"), "type", F.map_filter("props", lambda k, v: v.isNotNull()).alias("props"))
    ends = reached.select(F.col("key").alias("subject")), reached.select(F.col("key").alias("object"))
    within = edges.join(ends[0], "subject", "left_semi").join(ends[1], "object", "left_semi")
    return inside.select(F.to_json(entity).alias("json")), within.select(F.to_json(F.struct("subject", "predicate", "object", "weight")).alias("json"))


def subgraph_rows(graph: Graph, key: str, depth: int = 8) -> DataFrame:
    """(key, part, json): a row for each entity and triplet within `depth` hops, so that no task gathers them all."""
    entities, triplets = _within(graph, key, depth, None)
    named = lambda df, part: df.select(F.lit(key).alias("key"), F.lit(part).alias("part"), "json")
    return named(entities, "entity").unionByName(named(triplets, "triplet"))


def subgraph(graph: Graph, key: str, depth: int = 8, most: int = 32) -> DataFrame:
    """One row of JSON, {entities, triplets}: what lies within `depth` hops of a key. Hops end once more than `most`
    entities are found; `subgraph_rows` follows them all."""
    entities, triplets = _within(graph, key, depth, most)
    entities = entities.agg(F.sort_array(F.collect_list("json")).alias("entities"))
    triplets = triplets.agg(F.sort_array(F.collect_list("json")).alias("triplets"))
    return entities.crossJoin(triplets).select(F.lit(key).alias("key"), F.concat(F.lit('{"entities":['), F.array_join("entities", ","), F.lit('],"triplets":['), F.array_join("triplets", ","), F.lit("]}")).alias("json"))
