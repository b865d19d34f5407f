"""Standing rules: traversal queries over the keys that changed, set at a time.

A rule starts from the touched keys that are vertices. What it comes to are its hits, which get the posting
(key, RULE, name); touched keys that it doesn't come to lose it, and count as misses. Rules run in the order of their
names and see what those before them wrote. Property writes don't come back as changes; edges that were not there before
touch both their ends, which go into the next round, until a round adds none. With `max_rounds`, more rounds are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators.relation import VERTEX, Relation, empty
from ..plans.lexer import QuerySyntaxError
from ..plans.parser import Parser
from ..scratch import stored
from ..sources.graph import POSTINGS
from .index import add, remove

HITS = "key string, kind string, rule string, score double"


@dataclass
class Rule:
    name: str
    text: str
    applies: int = 0
    skips: int = 0
    hits: int = 0
    misses: int = 0


class Rules:
    def __init__(self, engine: Engine, max_rounds: int | None = None):
        self.engine, self.max_rounds = engine, max_rounds
        self.rules: dict[str, Rule] = {}
        self.converged = True
        self.query: StreamingQuery | None = None

    def set(self, name: str, text: str) -> str:
        """Checks the rule and keeps it; the reply tells which."""
        body = text[2:] if text[:2].lower() == "g:" else text
        Parser("traversal", {n: p for n, (p, _, _) in self.engine.steps.items()}).parse(body)
        if not body.strip():
            raise QuerySyntaxError("a rule has an expression")
        self.rules[name] = Rule(name, body)
        return f"Rule {name} is set"

    def list(self) -> list[Rule]:
        return [self.rules[n] for n in sorted(self.rules)]

    def get(self, name: str) -> Rule:
        return self.rules[name]

    def delete(self, name: str) -> None:
        if name == "*":
            self.rules.clear()
        else:
            self.rules.pop(name, None)

    def reset(self) -> None:
        for r in self.rules.values():
            r.applies = r.skips = r.hits = r.misses = 0

    def _once(self, rule: Rule, touched: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(hits as keys, ends of the edges that it added)."""
        e = self.engine
        keys = touched.join(e.graph.vertices.select(F.col("id").alias("key")), "key", "left_semi")
        rel, c = e.relation(rule.text, Relation(keys, VERTEX), "traversal")
        found = stored(rel.df.select("key").distinct())
        ends = None
        for links in c.links:
            own = links.select(F.explode(F.array("subject", "object")).alias("key")).distinct()
            ends = own if ends is None else ends.unionByName(own)
        ends = stored(ends) if ends is not None else None
        if c.wrote:
            e.graph = c.graph.changed(vertices=stored(c.graph.vertices), edges=stored(c.graph.edges))
        for name, rows, what in c.queues:
            e._enqueue(name, rows.with_df(stored(rows.df)), what)
        counted = touched.join(found.withColumn("_hit", F.lit(1)), "key", "left").agg(F.count("*"), F.sum(F.coalesce("_hit", F.lit(0))), F.sum(F.when(F.instr("key", ":") > 0, 1).otherwise(0))).first()
        total, hits, edges = (int(x or 0) for x in counted)
        rule.applies += total - edges
        rule.skips += edges
        rule.hits += hits
        rule.misses += total - edges - hits
        return found, ends

    def apply(self, keys: DataFrame) -> DataFrame:
        """Runs all rules on the keys; gives (key, kind, rule, score) of the hits and updates the index."""
        touched = stored(keys.select("key").distinct())
        out = empty(self.engine.spark, HITS)
        self.converged, rounds = False, 0
        while True:
            rounds += 1
            if self.max_rounds is not None and rounds > self.max_rounds:
                raise RuntimeError(f"rules still add edges after {self.max_rounds} rounds")
            nexts = None
            for rule in self.list():
                found, wrote = self._once(rule, touched)
                rows = found.select("key", F.lit("H").alias("kind"), F.lit(rule.name).alias("rule"), F.lit(1.0).alias("score"))
                out = out.join(touched.withColumn("rule", F.lit(rule.name)), ["key", "rule"], "left_anti").select("key", "kind", "rule", "score").unionByName(rows).distinct()
                self._post(rule.name, touched, rows)
                if wrote is not None:
                    nexts = wrote if nexts is None else nexts.unionByName(wrote)
            if nexts is None:
                break
            touched = stored(nexts.distinct())
            if touched.limit(1).count() == 0:
                break
            out = stored(out)
        self.converged = True
        return stored(out)

    def _post(self, name: str, touched: DataFrame, hits: DataFrame) -> None:
        g = self.engine.graph
        old = g.postings if g.postings is not None else empty(self.engine.spark, POSTINGS)
        at = lambda df: df.select("key", F.lit("H").alias("kind"), F.lit("RULE").alias("field"), F.lit(name.upper()).alias("token"), F.lit(1.0).alias("score"))
        self.engine.graph = g.changed(postings=stored(add(remove(old, at(touched)), at(hits))))

    def on(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Evaluates the rules on the keys of each batch of a change feed."""
        self.query = changes.writeStream.foreachBatch(lambda batch, _: self.apply(batch.select("key"))).option("checkpointLocation", checkpoint).start()
        return self.query

    def wait(self) -> None:
        self.query.processAllAvailable()
