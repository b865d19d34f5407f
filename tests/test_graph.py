"""Small graphs with known answers: incident and strict steps, paths, renames, drops, rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keyloom.engine import Engine
from keyloom.operators import paths
from keyloom.plans.lexer import QuerySyntaxError
from keyloom.sources.graph import EDGES, TYPE_TREE, VERTICES, Graph, driver_graph
from keyloom.sources.loaders import as_documents, load_graph_json, load_text, subgraph, subgraph_rows
from keyloom.streaming.rules import Rules


def edges(spark, triplets):
    rows = []
    for p, q, s, o, w in triplets:
        rows += [(f"{p}:{s}:{o}", p, s, o, f"{q}:{o}:{s}", w, None), (f"{q}:{o}:{s}", q, o, s, f"{p}:{s}:{o}", w, None)]
    return spark.createDataFrame(rows, EDGES)


def vertices(spark, rows):
    return spark.createDataFrame([(i, t, {"type": t} | p) for i, t, p in rows], VERTICES)


@pytest.fixture()
def shop(spark):
    v = vertices(spark, [("bambam", "person", {"age": "9"}), ("fred", "person", {"age": "47"}), ("barney", "person", {"age": "44"}), ("S1", "Sale", {}), ("S2", "Sale", {}), ("Amstel", "beer", {}), ("Still", "water", {})])
    e = edges(spark, [("Buyer", "bought", "bambam", "S1", 1.0), ("Buyer", "bought", "fred", "S2", 1.0), ("Item", "sold", "Amstel", "S1", 2.0), ("Item", "sold", "Still", "S2", 0.5)])
    tree = spark.createDataFrame([("V", "drink", "alcohol"), ("V", "drink", "water"), ("V", "alcohol", "beer"), ("V", "beer", "drink"), ("E", "Link", "Buyer")], TYPE_TREE)
    return Engine(spark, Graph.of(spark, v, e, type_tree=tree))


def keys(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def test_type_tree_with_a_cycle(shop):
    assert keys(shop.query("g:v(drink)")) == ["Amstel", "Still"]
    assert len(keys(shop.query("g:e(Link)"))) == 2


def test_incident_and_strict(shop):
    # By default an edge is followed from either end: the sales come back as themselves.
    assert keys(shop.query("g:v(Sale).out(Buyer)")) == ["S1", "S2"]
    assert keys(shop.query("g:v(Sale).in(Buyer)")) == ["bambam", "fred"]
    shop.strict = True
    assert keys(shop.query("g:v(person).out(Buyer)")) == ["S1", "S2"]
    assert keys(shop.query("g:v(Sale).out(Buyer)")) == []


def test_missing_compares_as_zero(shop):
    assert keys(shop.query("g:v().lt(age,21)")) == ["Amstel", "S1", "S2", "Still", "bambam"]


def test_hasout_filters_the_input(shop):
    assert keys(shop.query("g:v(person).hasout(Buyer)")) == ["bambam", "fred"]


def test_memo_and_set_operations(shop):
    assert keys(shop.query("g:v(Sale).in(Buyer).lt(age,21).as(w).out(Buyer).in(Item).reset().use(w)")) == ["bambam"]
    assert keys(shop.query("g:v(person) ! (v(person).hasout(Buyer))")) == ["barney"]
    both = keys(shop.query("g:v(person) | (v(Sale))"))
    assert both == keys(shop.query("g:v(Sale) | (v(person))")) and len(both) == 5


def test_path_of_two_hops(shop):
    row = shop.query("g:match(v(bambam),v(Amstel))").first()
    assert row.length == 2.0 and [s.key for s in row.path][0::2] == ["bambam", "S1", "Amstel"]
    assert sum(s.increment for s in row.path) == row.length


def test_weighted_path_takes_the_cheaper_way(spark):
    e = edges(spark, [("r", "r_", "a", "b", 1.0), ("r", "r_", "b", "c", 1.0), ("r", "r_", "a", "c", 5.0), ("x", "x_", "a", "d", 1.0)])
    eng = Engine(spark, Graph.of(spark, vertices(spark, [(k, "n", {}) for k in "abcde"]), e))
    assert eng.query("g:minimize(weight).match(v(a),v(c))").first().length == 2.0
    assert eng.query("g:match(v(a),v(c))").first().length == 1.0
    assert eng.query("g:maximize(weight).match(v(a),v(c))").first().length == 5.0
    assert eng.query("g:exclude(r).match(v(a),v(c))").count() == 0
    assert keys(eng.query("g:nomatch(v(a),v(e))").select("object")) == ["e"]
    with pytest.raises(ValueError):
        eng.query("g:include(r).exclude(x).match(v(a),v(c))")


def test_paths_of_any_length(spark):
    """A chain of 40 edges: its ends are connected, with all stops in order, and nomatch knows it."""
    e = edges(spark, [("r", "r_", f"k{i}", f"k{i + 1}", 1.0) for i in range(40)] + [("r", "r_", "far", "away", 1.0)])
    eng = Engine(spark, Graph.of(spark, vertices(spark, [(f"k{i}", "n", {}) for i in range(41)] + [("far", "n", {})]), e))
    row = eng.query("g:match(v(k0),v(k40))").first()
    assert row.length == 40.0 and [s.key for s in row.path][0::2] == [f"k{i}" for i in range(41)]
    assert keys(eng.query("g:nomatch(v(k0),v(k40,k35,far))").select("object")) == ["far"]


def test_paths_are_those_of_brute_force(spark):
    """All pairs of a random weighted graph: costs, and paths whose edges exist and add up to them."""
    rng = random.Random(3)
    names = [f"n{i}" for i in range(14)]
    weights = {}
    for _ in range(26):
        a, b = sorted(rng.sample(names, 2))
        weights[a, b] = float(rng.randint(1, 9))
    best = {(a, b): 0.0 if a == b else weights.get((min(a, b), max(a, b)), float("inf")) for a in names for b in names}
    for k in names:
        for a in names:
            for b in names:
                best[a, b] = min(best[a, b], best[a, k] + best[k, b])
    eng = Engine(spark, Graph.of(spark, vertices(spark, [(n, "n", {}) for n in names]), edges(spark, [("r", "r_", a, b, w) for (a, b), w in weights.items()])))
    rows = eng.query("g:minimize(weight).match(v(n),v(n))").collect()
    assert {(r.subject, r.object): r.length for r in rows} == {p: c for p, c in best.items() if p[0] != p[1] and c < float("inf")}
    for r in rows:
        stops = [s.key for s in r.path][0::2]
        assert (stops[0], stops[-1]) == (r.subject, r.object)
        assert sum(weights[min(p), max(p)] for p in zip(stops, stops[1:])) == r.length == sum(s.increment for s in r.path)
    lost = {p for p, c in best.items() if c == float("inf")}
    assert {(r.subject, r.object) for r in eng.query("g:nomatch(v(n),v(n))").collect()} == lost


def test_few_targets_of_many_sources(spark, monkeypatch):
    """The loop starts from the smaller set: as many rows as it reaches nodes. Ties go as they do from a single source."""
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample([f"n{i}" for i in range(12)], 2))) for _ in range(30)}
    e = edges(spark, [("r", "r_", a, b, float(rng.randint(1, 2))) for a, b in sorted(pairs)] + [("r", "r_", "lone", "other", 1.0)])
    eng = Engine(spark, Graph.of(spark, vertices(spark, [(f"n{i}", "n", {}) for i in range(12)] + [("lone", "n", {}), ("other", "m", {})]), e))
    rows, whole = [], paths.reached
    monkeypatch.setattr(paths, "reached", lambda *a: (rows.append((out := whole(*a)).count()), out)[1])
    named = lambda d: {(r.subject, r.object): (r.length, [tuple(s) for s in r.path]) for r in d.collect()}
    got = named(eng.query("g:minimize(weight).match(v(n),v(n0,other))"))
    assert rows == [12 + 2]
    single = named(eng.query("g:minimize(weight).match(v(n3),v(n0,other))")) | named(eng.query("g:minimize(weight).match(v(n7),v(n0,other))"))
    assert single == {p: x for p, x in got.items() if p[0] in ("n3", "n7")} and ("lone", "other") in got
    assert all(sum(i for _, i in path) == length for length, path in got.values())


def test_the_cheapest_go_first(spark, monkeypatch):
    """Costs to the targets end the search before the dear part of the graph is entered, and stay right."""
    monkeypatch.setattr(paths, "PORTION", 1)
    half = lambda rows: spark.createDataFrame([(x, y, f"{a}{b}", w) for a, b, w in rows for x, y in ((a, b), (b, a))], "a string, b string, edge_id string, w double")
    named = lambda *names: spark.createDataFrame([(x,) for x in names], "key string")
    dear = [("s", "m", 1.0), ("m", "t", 1.0), ("s", "x", 100.0), *[("x", f"y{i}", 100.0) for i in range(30)]]
    assert sorted(r.node for r in paths.reached(named("s"), half(dear), named("t")).collect()) == ["m", "s", "t", "x"]
    rng = random.Random(9)
    pairs = {tuple(sorted(rng.sample(range(12), 2))): float(rng.randint(0, 9)) for _ in range(24)}
    best = {(i, j): 0.0 if i == j else pairs.get((min(i, j), max(i, j)), float("inf")) for i in range(12) for j in range(12)}
    for k in range(12):
        best |= {(i, j): min(c, best[i, k] + best[k, j]) for (i, j), c in best.items()}
    found = paths.reached(named("0", "1"), half([(str(a), str(b), w) for (a, b), w in pairs.items()]), named("7", "8", "9")).collect()
    assert {(r.source, r.node): r.cost for r in found if r.node in "789"} == {(str(i), str(j)): best[i, j] for i in (0, 1) for j in (7, 8, 9) if best[i, j] < float("inf")}


def test_excluded_twins_are_not_looked_up(spark):
    """Where predicates tell the twins, no edge of an excluded predicate is read."""
    graph = driver_graph(spark, "/root/testdata/sf0.001")
    half = paths.half_edges(graph, [], ["lives_in", "placed_by", "contains", "supplied_by"], None)
    plan = half._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "o_custkey" not in plan and "Join" not in plan
    slow = paths.half_edges(graph.changed(edges=graph.edges), [], ["lives_in", "placed_by", "contains", "supplied_by"], None)
    assert sorted(map(tuple, half.collect())) == sorted(map(tuple, slow.collect()))


def test_surroundings_read_what_types_allow(spark):
    """Two hops from a region lead to its nations, customers and suppliers: no order and no part is read."""
    graph = driver_graph(spark, "/root/testdata/sf0.001")
    near = subgraph_rows(graph, "region/1", 2)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "o_custkey" not in plan
    whole = subgraph_rows(graph.changed(edges=graph.edges), "region/1", 2)
    assert near.count() == whole.count() > 0 and near.exceptAll(whole).count() == 0


def test_multi_match(spark):
    e = edges(spark, [("r", "r_", "a", "b", 1.0), ("r", "r_", "b", "c", 1.0)])
    eng = Engine(spark, Graph.of(spark, vertices(spark, [(k, "n", {}) for k in "abc"]), e))
    row = eng.query("g:match(v(a),v(b),v(c))").first()
    assert row.length == 2.0  # the leg from last to first, the longest, is dropped


def test_rename_and_back(shop):
    before = sorted(map(str, shop.graph.edges.select("edge_id", "inverse_id").collect()))
    shop.query("g:renamekeys(bambam,tom)")
    assert "Buyer:tom:S1" in keys(shop.graph.edges)
    shop.query("g:renamekeys(tom,bambam)")
    assert sorted(map(str, shop.graph.edges.select("edge_id", "inverse_id").collect())) == before


def test_drop_takes_twins(shop):
    shop.query("g:v(S1).drop()")
    assert not [k for k in keys(shop.graph.edges) if "S1" in k]
    assert len(keys(shop.graph.edges)) == 4


def test_properties(shop):
    shop.query("g:v(fred).property(status,old,age,'')")
    props = shop.graph.vertices.where("id = 'fred'").first().props
    assert props["status"] == "old" and "age" not in props
    shop.query("g:v(barney).property{next = age + 1}")
    assert shop.graph.vertices.where("id = 'barney'").first().props["next"] == "45.000000"


def test_edges_between_sets_have_no_self_pairs(shop):
    shop.query("g:predicate(knows,known_by).subject(v(person)).object(v(person))")
    assert shop.graph.edges.where("predicate = 'knows'").count() == 6
    assert shop.graph.edges.where("predicate = 'known_by'").count() == 6


def test_adding_twice_changes_nothing(shop):
    shop.query("g:addv(fred,other)")
    assert shop.graph.vertices.where("id = 'fred'").first().type == "person"


def test_errors(shop):
    for bad in ("g:reset()", "g:predicate(p)", "g:v(fred).redis(flushall,x,y)", "science"):
        with pytest.raises(QuerySyntaxError):
            shop.query(bad)


def test_sale_rule(shop, spark):
    """The buyers under age and, as a missing age is 0, the sales themselves are marked."""
    rules = Rules(shop)
    assert "is set" in rules.set("agecheck", "g:has(type,Sale).in(Buyer).lt(age,21).property(status,age_check).redis(rpush,queue,'@key')")
    hits = rules.apply(spark.createDataFrame([("S1",), ("S2",), ("fred",), ("Buyer:bambam:S1",)], "key string"))
    assert {"bambam"} <= {r.key for r in hits.collect()}
    assert shop.graph.vertices.where("id = 'bambam'").first().props["status"] == "age_check"
    assert "status" not in shop.graph.vertices.where("id = 'fred'").first().props
    r = rules.get("agecheck")
    assert r.skips == 1 and r.hits + r.misses == r.applies
    assert rules.converged
    assert "bambam" in [x.value for x in shop.queues["queue"].collect()]
    assert shop.fetch("agecheck", "RULE").count() >= 1
    rules.reset()
    assert rules.get("agecheck").applies == 0
    rules.delete("*")
    assert rules.list() == []


def test_rules_go_on_while_they_add_edges(spark):
    """Each round walks one step down a chain of eight, until no edge is new."""
    v = vertices(spark, [(f"k{i}", "n", {"next": f"k{i + 1}"}) for i in range(8)] + [("k8", "n", {})])
    shop = Engine(spark, Graph.of(spark, v))
    rules = Rules(shop)
    rules.set("walk", "g:haslabel(next).adde('@next',then,before)")
    rules.apply(spark.createDataFrame([("k0",)], "key string"))
    assert rules.converged and shop.graph.edges.where("predicate = 'then'").count() == 8
    short = Rules(Engine(spark, Graph.of(spark, v)), max_rounds=3)
    short.set("walk", "g:haslabel(next).adde('@next',then,before)")
    with pytest.raises(RuntimeError):
        short.apply(spark.createDataFrame([("k0",)], "key string"))


def test_type_tree_grows(shop):
    assert keys(shop.query("g:v(thing)")) == []
    shop.type_tree_add("thing", "drink")
    shop.type_tree_add("thing", "person")
    assert keys(shop.query("g:v(thing)")) == ["Amstel", "Still", "bambam", "barney", "fred"]


def test_nested_triplets_of_any_depth(spark, tmp_path):
    item = {"iri": "v0", "type": "n"}
    for k in range(7):
        item = {"subject": item, "predicate": f"p{k}", "object": f"v{k + 1}"}
    (tmp_path / "g.json").write_text(json.dumps([item]))
    g = load_graph_json(spark, str(tmp_path / "g.json"))
    assert {r.predicate for r in g.edges.collect()} == {f"p{k}" for k in range(7)}


def test_queue_values(shop):
    shop.query("g:v(bambam).redis(rpush,q,'@graph')")
    shop.query("g:v(bambam).redis(rpush,q,'@tuple')")
    graph, row = (json.loads(r.value) for r in shop.queues["q"].collect())
    assert sorted(t["predicate"] for t in graph["triplets"]) == ["Buyer", "bought"] and row["key"] == "bambam"
    with pytest.raises(QuerySyntaxError):
        shop.query("g:v(bambam).redis(rpush,q,'@all')")


def test_load_text(spark, tmp_path):
    (tmp_path / "p.tsv").write_bytes('key\ttype\tfull (name)\tage\r\nfred\tperson\t"Fred  "\t47\r\nwilma\tperson\tWilma\t\r\n'.encode())
    rows = {r.key: r for r in load_text(spark, str(tmp_path / "p.tsv")).collect()}
    assert rows["fred"].props == {"type": "person", "full _name_": "Fred", "age": "47"} and rows["wilma"].type == "person"
    assert "age" not in rows["wilma"].props
    text = {r.key: r.text for r in as_documents(load_text(spark, str(tmp_path / "p.tsv")), "TEXT").collect()}
    assert text["fred"] == "type:person;full _name_:Fred;age:47;"
    assert json.loads(as_documents(load_text(spark, str(tmp_path / "p.tsv")), "JSON").where("key = 'wilma'").first().text)["full _name_"] == "Wilma"


def test_graph_json_and_export(spark, tmp_path):
    data = [{"iri": "fred", "type": "person", "age": "47"}, {"subject": {"iri": "pebbles", "type": "person"}, "predicate": {"type": "father", "inverse": "child", "weight": "0.5"}, "object": "fred"}]
    (tmp_path / "g.json").write_text(json.dumps(data))
    g = load_graph_json(spark, str(tmp_path / "g.json"))
    assert keys(g.edges) == ["child:fred:pebbles", "father:pebbles:fred"]
    assert keys(g.vertices) == ["fred", "pebbles"]
    out = json.loads(subgraph(g, "pebbles", 2).first().json)
    assert {e["iri"] for e in out["entities"]} == {"fred", "pebbles"} and len(out["triplets"]) == 2


def test_custom_step_and_removal(shop):
    @shop.step("longer", arity=1)
    def longer(df, n):
        return df.where(F.length("key") > int(n))

    assert keys(shop.query("g:v(person).longer(4)")) == ["bambam", "barney"]
    shop.remove_step("longer")
    with pytest.raises(QuerySyntaxError):
        shop.query("g:v(person).longer(4)")
