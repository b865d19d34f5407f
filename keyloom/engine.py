"""The engine: one graph snapshot, its index, and queries over them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analyse
from .operators import keysets
from .operators.relation import EDGE, GROUP, POSTING, TRIPLET, VERTEX, Relation
from .operators.traverse import properties
from .plans import compile as plan
from .plans.lexer import QuerySyntaxError
from .plans.parser import Parser, dialect_of, postfix_text
from .scratch import stored
from .sources.graph import TYPE_TREE, Graph

_MODIFIERS = re.compile(r"\s+(?:(?P<ranked>ranked)|(?P<reset>reset)|over\s+(?P<over>-?[0-9.]+)|under\s+(?P<under>-?[0-9.]+)|as\s+(?P<as>\w+))\s*$", re.IGNORECASE)


@dataclass(frozen=True)
class Modifiers:
    ranked: bool = False
    over: float | None = None
    under: float | None = None
    name: str | None = None


def modifiers(text: str) -> tuple[str, Modifiers]:
    """Strips RANKED, RESET, OVER x, UNDER x and AS name from the end of a query."""
    found: dict = {}
    while m := _MODIFIERS.search(text):
        text = text[: m.start()]
        found |= {k: v for k, v in m.groupdict().items() if v}
    return text, Modifiers("ranked" in found, float(found["over"]) if "over" in found else None, float(found["under"]) if "under" in found else None, found.get("as"))


class Engine:
    def __init__(self, spark: SparkSession, graph: Graph, strict: bool = False, default_operator: str = "|", scoring: str = "weighted"):
        self.spark, self.graph, self.strict, self.default_operator, self.scoring = spark, graph, strict, default_operator, scoring
        self.steps: dict[str, tuple[int, Callable, bool]] = {}
        self.scripts: dict[str, tuple[Callable, str]] = {}
        self.queues: dict[str, DataFrame] = {}

    # -- extension

    def step(self, name: str, priority: int = 500, arity: int = 0, writes: bool = False):
        """Registers a traversal step: a function of (DataFrame, *parameters) that gives a DataFrame with a key."""

        def keep(fn: Callable):
            def apply(c: plan.Context, op: str, dialect: str) -> None:
                words = c.texts() if arity else []
                rel = c.current()
                c.wrote |= writes
                c.push(Relation(fn(rel.df, *words[:arity]), rel.kind))

            self.steps[name.lower()] = (priority, apply, writes)
            return fn

        return keep

    def remove_step(self, name: str) -> None:
        del self.steps[name.lower()]

    def load_script(self, name: str, fn: Callable, schema: str) -> None:
        """A function over batches of keys (pandas), for eval_script."""
        self.scripts[name] = (fn, schema)

    def eval_script(self, query: str, name: str) -> DataFrame:
        fn, schema = self.scripts[name]
        return self.query(query).mapInPandas(fn, schema)

    # -- index

    def reindex(self) -> DataFrame:
        """Builds the postings of all documents anew and stores them where they are made, each file in order of tokens, so
        that a term reads its own pages of the files only. No posting is shuffled."""
        made = analyse.postings(self.graph.documents, self.scoring)
        self.graph = self.graph.changed(postings=stored(made.sortWithinPartitions("token", "field")))
        return self.graph.postings

    def use_index(self, postings: DataFrame) -> None:
        """Takes postings that were stored before."""
        self.graph = self.graph.changed(postings=postings)

    def type_tree_add(self, super_type: str, sub_type: str, kind: str = "V") -> None:
        """Puts a type of vertices (V) or a predicate (E) below another one; what is there already stays."""
        new = self.spark.createDataFrame([(kind, super_type, sub_type)], TYPE_TREE)
        old = self.graph.type_tree
        self.graph = self.graph.changed(type_tree=new if old is None else old.unionByName(new).distinct())

    def fetch(self, token: str | None = None, field: str | None = None, op: str = "==") -> DataFrame:
        return keysets.fetch(self.graph.postings, token, field, op).df

    def describe(self, token: str = "*", field: str | None = None) -> DataFrame:
        return keysets.describe(self.graph.postings, token, field)

    # -- queries

    @staticmethod
    def parse(text: str) -> str:
        return postfix_text(text)

    def relation(self, text: str, start: Relation | None = None, dialect: str | None = None) -> tuple[Relation, plan.Context]:
        own, body = dialect_of(text)
        dialect = dialect or own
        extra = {n: p for n, (p, _, _) in self.steps.items()}
        postfix = Parser(dialect, extra if dialect == "traversal" else None, self.default_operator).parse(body)
        c = plan.Context(self.graph, self.strict, extra={n: fn for n, (_, fn, _) in self.steps.items()})
        if start is not None:
            c.push(start)
        return plan.run(c, postfix, dialect), c

    def query(self, text: str, ranked: bool = False, over: float | None = None, under: float | None = None, fetch_rows: bool = False, graph: bool = False, ordered: bool = False) -> DataFrame:
        """Runs a query of either language. A write query moves the engine on to the snapshot that it makes.

        ordered: rows in the natural order of their keys, for a sink that keeps it."""
        text = ("g:" + text) if graph else text
        text, mods = modifiers(text)
        rel, c = self.relation(text)
        if c.wrote:
            self.graph = c.graph
        for name, rows, what in c.queues:
            self._enqueue(name, rows, what)
        over, under = mods.over if over is None else over, mods.under if under is None else under
        if over is not None:
            rel = keysets.over(rel, over)
        if under is not None:
            rel = keysets.under(rel, under)
        rel = c.graph.load(rel, c.select)
        if ranked or mods.ranked:
            rel = keysets.ranked(rel)
        out = self.result(rel, c.select, fetch_rows)
        return out.orderBy(*[c for c in ("key", "subject", "object") if c in out.columns]) if ordered else out

    def _enqueue(self, name: str, rel: Relation, what: str) -> None:
        rows = rel.df
        if what == "@graph":  # the row with the edges that touch it
            ends = self.graph.edges.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("key"), F.struct("subject", "predicate", "object", "weight").alias("t"))
            rows = rows.select("key").distinct().join(ends, "key", "left").groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("triplets"))
        elif what.startswith("@") and what not in ("@key", "@tuple"):
            raise QuerySyntaxError(f"{what} is none of @key, @tuple and @graph")
        whole = lambda: F.to_json(F.struct(*rows.columns))
        value = {"@key": lambda: F.col("key"), "@tuple": whole, "@graph": whole}.get(what, lambda: F.lit(what))()
        new = rows.select(F.lit(name).alias("name"), value.alias("value"))
        self.queues[name] = self.queues[name].unionByName(new) if name in self.queues else new

    def result(self, rel: Relation, select: list[str], fetch_rows: bool = False) -> DataFrame:
        """Columns by kind: keysets (key, kind, score), triplets, groups (key, members), else keys; with select, fields."""
        if select:
            return rel.df.select("key", *properties(rel, select))
        if rel.kind == POSTING:
            out = rel.df.select("key", "kind", "score")
        elif rel.kind == TRIPLET:
            out = rel.df.select("subject", "object", "length", "path")
        elif rel.kind == GROUP:
            out = rel.df.select("key", "members", *(["length"] if "length" in rel.df.columns else []))
        elif rel.kind == "row":
            return rel.df
        else:
            out = rel.df.select("key", *[c for c, t in rel.df.dtypes if t.startswith("struct")])
        if fetch_rows and rel.kind in (VERTEX, EDGE, POSTING):
            out = out.join(self.values(), "key", "left")
        return out

    def values(self) -> DataFrame:
        """(key, value): stored properties of vertices, edges and documents; a text stands under `text`."""
        clean: Callable[[str | Column], Column] = lambda p: F.map_filter(p, lambda k, v: v.isNotNull())
        out = self.graph.vertices.select(F.col("id").alias("key"), clean("props").alias("value"))
        if self.graph.documents is not None:
            d = self.graph.documents
            text = F.create_map(F.lit("text"), F.col("text"))
            out = out.unionByName(d.select("key", clean(F.map_concat(F.coalesce("props", F.create_map().cast("map<string,string>")), text)).alias("value")))
        return out


__all__ = ["Engine", "Graph", "QuerySyntaxError", "modifiers"]
