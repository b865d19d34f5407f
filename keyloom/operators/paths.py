"""Shortest paths over the undirected graph: match, nomatch, several stops, and costs to minimise or maximise.

A hop goes vertex - edge - vertex in two halves; its cost is the weight of the edge or a property or expression of it.
`minimize` gives a true shortest path of any number of hops. Ties go to fewer hops, then, from the end back, to the
smaller edge. All sources are solved in one loop of relaxations keyed by (source, node) on narrow rows, until no node
gains; a source whose targets are all reached goes no further than the costliest of them. A round writes what gained in
it only. Paths are then followed back from the targets, so no row of the loop carries one. Hops go both ways at one cost,
so where the targets are fewer the loop starts from them: its rows are the smaller set times the nodes, never the larger.
Paths then grow from the targets, only over nodes that lie on a shortest path from a source, and the least by edges stays.

`nomatch` asks for components, not for paths. `maximize` is a heuristic, as the longest simple path is NP-hard: a loop
keeps the costliest simple path of up to `max_hops` hops for each node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from ..sources.graph import Graph
from .relation import TRIPLET, Relation
from .traverse import edges_of

#: Hops of a path that `maximize` looks for.
MAX_HOPS = 32
#: Rounds of the loop after which what they gained is merged.
MERGE_ROUNDS = 12
#: Nodes that a search with targets goes on from at first; doubled with each portion.
PORTION = 4096
PATH = "array<struct<key: string, increment: double>>"


def half_edges(graph: Graph, include: list[str], exclude: list[str], cost: Column | None) -> DataFrame:
    """(a, b, edge_id, w): each edge from both ends, an edge and its twin once; filtered before any loop."""
    if include and exclude:
        raise ValueError("include and exclude can't be used together")
    edges = edges_of(graph, include) if include else graph.edges
    if exclude:
        out = [x for p in exclude for x in graph.closure("E", p)]
        if graph.twins and not any(c in p for p in exclude for c in "*?["):  # twins are told by their predicates
            edges = edges.where(~F.col("predicate").isin([*out, *(graph.twins[p] for p in out if p in graph.twins)]))
        else:
            twins = edges_of(graph, exclude).select(F.col("inverse_id").alias("edge_id"))
            edges = edges.where(~F.col("predicate").isin(out)).join(twins, "edge_id", "left_anti")
    w = cost if cost is not None else F.lit(1.0)
    edges = edges.select("edge_id", "subject", "object", w.cast("double").alias("w"))
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b"), "edge_id", "w").unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"), "edge_id", "w"))
    return both.where("a <> b").groupBy("a", "b").agg(F.min(F.struct("w", "edge_id")).alias("m")).select("a", "b", F.col("m.edge_id").alias("edge_id"), F.col("m.w").alias("w"))


def _best(rounds: list[DataFrame]) -> DataFrame:
    """(source, node, cost, hops): the least of what the rounds gained."""
    least = F.min(F.struct(F.round("cost", 9).alias("c"), "hops", "cost")).alias("m")
    return reduce(DataFrame.unionByName, rounds).groupBy("source", "node").agg(least).select("source", "node", "m.cost", "m.hops")


def reached(sources: DataFrame, half: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(source, node, cost, hops) of the nodes that the sources reach; all that matter for the targets, if there are any.

    half: stored. Ends as soon as no node gains, which non-negative costs make sure of. Where many nodes wait, the cheapest
    go first, in portions that double, so that the targets' costs bound the search before it spreads; no node is left out
    but those that cost more than all targets of their source."""
    front = stored(sources.select(F.col("key").alias("source"), F.col("key").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops")).distinct())
    rounds, portion, limit, waiting = [front], PORTION, None, front
    n, starts = (targets.count(), front.count()) if targets is not None else (0, 0)
    while size := waiting.count():
        known = _best(rounds)
        within = lambda d: d
        if n:
            ends = known.join(targets.select(F.col("key").alias("node")), "node").groupBy("source").agg(F.count("*").alias("n"), F.max("cost").alias("most")).where(F.col("n") >= n).select("source", "most")
            if size > portion:  # edges that cost more than any bound lead nowhere
                ends = stored(ends)
                count, most = ends.agg(F.count("*"), F.max("most")).first()
                if count == starts and (limit is None or most < limit / 2):
                    half, limit = stored(half.where(F.round("w", 9) <= round(most, 9) + 1e-9)), most
            within = lambda d: d.join(ends, "source", "left").where("most IS NULL OR round(cost, 9) <= round(most, 9)").drop("most")
        front, rest = within(waiting), None
        if n and size > portion:
            front = stored(front)
            step = front.agg(F.percentile_approx("cost", min(1.0, portion / size), F.lit(10_000))).first()[0]
            front, rest = front.where(F.col("cost") <= step), front.where(F.col("cost") > step)
            portion *= 2
        moved = front.join(half, front.node == half.a).select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        moved = _best([within(moved)])
        old = known.select("source", "node", F.col("cost").alias("_c"), F.col("hops").alias("_h"))
        gain = "_c IS NULL OR round(cost, 9) < round(_c, 9) OR round(cost, 9) = round(_c, 9) AND hops < _h"
        gained = stored(moved.join(old, ["source", "node"], "left").where(gain).select("source", "node", "cost", "hops"))
        waiting = gained if rest is None else stored(_best([gained, rest]))
        rounds.append(gained)
        if len(rounds) > MERGE_ROUNDS:
            rounds = [stored(_best(rounds))]
    return _best(rounds)


def _step(key: Column, increment: Column) -> Column:
    return F.struct(key.alias("key"), increment.cast("double").alias("increment"))


def shortest(graph: Graph, sources: DataFrame, half: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, node, cost, hops, path) for all pairs of a source and another node among the targets with a path."""
    half = stored(half)
    if half.where("w < 0").limit(1).count():
        raise ValueError("costs to minimise can't be negative")
    if targets.count() < sources.count():
        return _from_targets(sources, half, targets)
    best = stored(reached(sources, half, targets))
    pairs = best.join(targets.select(F.col("key").alias("node")), "node", "left_semi").where("source <> node")
    start = F.array(_step(F.col("source"), F.lit(0.0)), ).cast(PATH)
    at = stored(pairs.select("source", F.col("node").alias("target"), F.col("cost").alias("total"), F.col("hops").alias("length"), "node", "cost", "hops", F.lit(None).cast(PATH).alias("path")))
    done = []
    before = best.select(F.col("source").alias("s"), F.col("node").alias("a"), F.col("cost").alias("_c"), F.col("hops").alias("_h"))
    while at.limit(1).count():
        back = at.join(half, at.node == half.b).join(before, ["a"]).where("source = s AND _h + 1 = hops AND round(_c + w, 9) = round(cost, 9)")
        added = F.array(_step(F.col("edge_id"), F.col("w") / 2), _step(F.col("node"), F.col("w") / 2))
        chosen = F.min_by(F.struct("a", "_c", "_h", F.concat(added, F.coalesce("path", F.array().cast(PATH))).alias("path")), F.struct("edge_id", "a"))
        at = stored(back.groupBy("source", "target", "total", "length").agg(chosen.alias("m")).select("source", "target", "total", "length", F.col("m.a").alias("node"), F.col("m._c").alias("cost"), F.col("m._h").alias("hops"), "m.path"))
        done.append(at.where("hops = 0"))
        at = at.where("hops > 0")
    rows = reduce(DataFrame.unionByName, done) if done else at
    return rows.select("source", F.col("target").alias("node"), F.col("total").alias("cost"), F.col("length").alias("hops"), F.concat(start, "path").alias("path"))


def _from_targets(sources: DataFrame, half: DataFrame, targets: DataFrame) -> DataFrame:
    """What `shortest` gives, by a loop that starts from the targets. half: stored."""
    best = stored(reached(targets, half, sources)).select(F.col("source").alias("target"), "node", "cost", "hops")
    ends = sources.select(F.col("key").alias("node"))
    pairs = stored(best.join(ends, "node", "left_semi").where("node <> target"))
    most = pairs.agg(F.max("hops")).first()[0] or 0
    # the nodes that lie on a shortest path, from the farthest sources on; a level holds those of as many hops
    levels, gains = {most + 1: pairs.limit(0)}, "round(cost + w, 9) = round(_c, 9)"
    for hops in range(most, 0, -1):
        far = levels[hops + 1].select("target", "node", F.col("cost").alias("_c"))
        near = best.where(F.col("hops") == hops).join(half.select(F.col("b").alias("node"), "a", "w"), "node").join(far.withColumnRenamed("node", "a"), ["target", "a"]).where(gains)
        levels[hops] = stored(pairs.where(F.col("hops") == hops).select("target", "node", "cost", "hops").unionByName(near.select("target", "node", "cost", "hops")).distinct())
    at = targets.select(F.col("key").alias("target"), F.col("key").alias("node"), F.lit(0.0).alias("cost"), F.array().cast("array<struct<edge_id: string, a: string, w: double>>").alias("back"))
    done = []
    for hops in range(1, most + 1):
        far = levels[hops].select("target", F.col("node").alias("a"), F.col("cost").alias("_c"))
        out = at.join(half, at.node == half.b).join(far, ["target", "a"]).where(gains)
        at = stored(out.groupBy("target", F.col("a").alias("node")).agg(F.min("_c").alias("cost"), F.min(F.concat("back", F.array(F.struct("edge_id", "a", "w")))).alias("back")))
        done.append(at.join(ends, "node", "left_semi").withColumn("hops", F.lit(hops)))
    if not done:
        return pairs.select(F.col("node").alias("source"), F.col("target").alias("node"), "cost", "hops", F.lit(None).cast(PATH).alias("path"))
    rows = reduce(DataFrame.unionByName, done)
    nodes = F.concat(F.slice(F.transform(F.reverse("back"), lambda x: x["a"]), 2, F.size("back")), F.array("target"))
    steps = F.transform(F.arrays_zip(F.reverse("back").alias("e"), nodes.alias("n")), lambda x: F.array(_step(x["e"]["edge_id"], x["e"]["w"] / 2), _step(x["n"], x["e"]["w"] / 2)))
    path = F.concat(F.array(_step(F.col("node"), F.lit(0.0))), F.flatten(steps)).cast(PATH)
    return rows.select(F.col("node").alias("source"), F.col("target").alias("node"), "cost", "hops", path.alias("path"))


def costliest(graph: Graph, sources: DataFrame, half: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(source, node, cost, hops, path): the costliest simple paths found within max_hops."""
    half = stored(half)
    start = F.array(_step(F.col("key"), F.lit(0.0))).cast(PATH)
    best = stored(sources.select(F.col("key").alias("source"), F.col("key").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), start.alias("path")).distinct())
    front = best
    for _ in range(max_hops):
        moved = front.join(half, front.node == half.a).where(~F.exists("path", lambda s: s["key"] == F.col("b")))
        moved = moved.select("source", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array(_step(F.col("edge_id"), F.col("w") / 2), _step(F.col("b"), F.col("w") / 2))).alias("path"))
        rank = F.struct((-F.round("cost", 9)).alias("c"), "hops", "path", "cost")
        moved = moved.groupBy("source", "node").agg(F.min(rank).alias("m")).select("source", "node", "m.cost", "m.hops", "m.path")
        old = best.select("source", "node", F.col("cost").alias("_c"), F.col("hops").alias("_h"), F.col("path").alias("_p"))
        same = F.round("_c", 9) == F.round("cost", 9)
        gain = F.col("_c").isNull() | (F.round("_c", 9) < F.round("cost", 9)) | (same & ((F.col("_h") > F.col("hops")) | ((F.col("_h") == F.col("hops")) & (F.struct(F.col("_p").alias("p")) > F.struct(F.col("path").alias("p"))))))
        front = stored(moved.join(old, ["source", "node"], "left").where(gain).select("source", "node", "cost", "hops", "path"))
        if front.limit(1).count() == 0:
            break
        best = stored(best.join(front.select("source", "node"), ["source", "node"], "left_anti").unionByName(front))
    return best


def components(half: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component with an edge, by large-star and small-star rounds."""
    edges = stored(half.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        edges = stored(small.select("x.*").where("u <> v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def match(graph: Graph, sets: list[DataFrame], include: list[str] | None = None, exclude: list[str] | None = None, cost: Column | None = None, maximize: bool = False, max_hops: int = MAX_HOPS) -> Relation:
    """match(A, B): one path for each reachable pair. match(A, B, C, ..): combinations of distinct stops for which each
    neighbouring pair and the last with the first have a path; the paths are joined and the longest leg is dropped."""
    half = half_edges(graph, include or [], exclude or [], cost)
    sets = [s.select("key").distinct() for s in sets]

    def legs_of(starts: DataFrame, targets: DataFrame) -> DataFrame:
        if maximize:
            return costliest(graph, starts, half, max_hops).join(targets.select(F.col("key").alias("node")), "node").where("source <> node")
        return shortest(graph, starts, half, stored(targets))

    if len(sets) == 2:
        found = legs_of(*sets)
        return Relation(found.select(F.col("node").alias("key"), F.col("source").alias("subject"), F.col("node").alias("object"), F.col("cost").alias("length"), "path"), TRIPLET)
    every_stop = stored(reduce(DataFrame.unionByName, sets).distinct())
    legs = stored(legs_of(every_stop, every_stop))
    n = len(sets)
    out = None
    for i in range(n):
        j = (i + 1) % n
        pair = legs.join(sets[i].withColumnRenamed("key", "source"), "source", "left_semi").join(sets[j].withColumnRenamed("key", "node"), "node", "left_semi")
        pair = pair.select(F.col("source").alias(f"s{i}"), F.col("node").alias(f"s{j}"), F.struct("cost", "path").alias(f"leg{i}"))
        out = pair if out is None else out.join(pair, [f"s{i}"] if j else [f"s{i}", "s0"])
    stops = [F.col(f"s{i}") for i in range(n)]
    out = out.where(F.size(F.array_distinct(F.array(*stops))) == n)
    every = F.array(*[F.struct(F.col(f"leg{i}.cost").alias("cost"), F.lit(i).alias("i"), F.col(f"leg{i}.path").alias("path")) for i in range(n)])
    longest = F.array_max(F.transform(every, lambda x: F.struct(x["cost"], x["i"])))["i"]
    kept = F.filter(every, lambda x: x["i"] != longest)
    path = F.flatten(F.transform(kept, lambda x: x["path"]))
    length = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["cost"])
    return Relation(out.select(F.col(f"s{n - 1}").alias("key"), F.col("s0").alias("subject"), F.col(f"s{n - 1}").alias("object"), length.alias("length"), path.alias("path"), F.array(*stops).alias("stops")), TRIPLET)


def nomatch(graph: Graph, a: DataFrame, b: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> Relation:
    """Pairs of the two sets without a path; the sets are named by the query, and their product is its result."""
    roots = components(half_edges(graph, include or [], exclude or [], None))
    side = lambda df, name: df.select(F.col("key").alias("node")).distinct().join(roots, "node", "left").select(F.col("node").alias(name), F.coalesce("root", "node").alias(f"{name}_root"))
    out = side(a, "subject").join(side(b, "object"), F.expr("subject <> object AND subject_root <> object_root"))
    return Relation(out.select(F.col("object").alias("key"), "subject", "object", F.lit(0.0).alias("length"), F.array().cast(PATH).alias("path")), TRIPLET)


def path_length(path: Column) -> Column:
    """The sum of a path's increments."""
    return F.aggregate(path, F.lit(0.0), lambda s, x: s + x["increment"])
