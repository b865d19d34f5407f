"""Postfix to DataFrames: a stack machine that runs while the plan is built and touches no data.

Operands are words and lists until a step asks for a set; a word then is a memoised set, a type, a key or an index term.
Steps are methods named by the registry below; @step adds more.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.expr import COMPARISONS, atof, compare, glob, token_number
from ..functions.objects import compile_object, fields_of, trend, words_of
from ..operators import keysets, mutate, paths
from ..operators import traverse as tr
from ..operators.relation import EDGE, GROUP, POSTING, TRIPLET, VERTEX, Relation
from ..sources.graph import Graph
from .lexer import QuerySyntaxError, Token

log = logging.getLogger(__name__)


@dataclass
class PendingEdge:
    predicate: str
    inverse: str | None = None
    subject: Relation | None = None
    object: Relation | None = None


@dataclass
class Context:
    graph: Graph
    strict: bool = False
    max_hops: int = paths.MAX_HOPS
    stack: list = field(default_factory=list)
    memo: dict[str, Relation] = field(default_factory=dict)
    select: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    cost: object = None  # a field name or an object token
    maximize: bool = False
    edge: PendingEdge | None = None
    queues: list[tuple[str, Relation, str]] = field(default_factory=list)
    wrote: bool = False
    links: list = field(default_factory=list)  # edges that were added, as frames
    extra: dict[str, Callable] = field(default_factory=dict)

    # -- operands

    def words(self) -> list:
        """The parameters on top of the stack, if any: a list of texts, relations and object tokens."""
        if self.stack and isinstance(self.stack[-1], (Token, list)):
            top = self.stack.pop()
            return [x if not isinstance(x, Token) or x.kind == "object" else x.text for x in (top if isinstance(top, list) else [top])]
        return []

    def texts(self) -> list[str]:
        return [x for x in self.words() if isinstance(x, str)]

    def pop(self, op: str = "a step"):
        if not self.stack:
            raise QuerySyntaxError(f"{op} lacks an operand")
        return self.stack.pop()

    def current(self) -> Relation:
        """The set that a step works on; all vertices where there is none."""
        while self.stack and isinstance(self.stack[-1], (Token, list)) and not isinstance(self.stack[-1], Relation):
            return self.resolve(self.stack.pop())
        return self.stack.pop() if self.stack else self.graph.vertex_relation()

    def resolve(self, x) -> Relation:
        if isinstance(x, Relation):
            return x
        if isinstance(x, list):
            return self.vertices([t.text if isinstance(t, Token) else t for t in x])
        name = x.text if isinstance(x, Token) else x
        return self.memo[name] if name in self.memo else self.vertices([name])

    def _key_exists(self, name: str) -> bool:
        if self.graph.typed:
            kind, _, _ = name.partition("/")
            return kind in self.graph.typed and self.graph.typed[kind].where(F.col("key") == name).limit(1).count() > 0
        return self.graph.vertices.where(F.col("id") == name).limit(1).count() > 0

    def vertices(self, words: list[str]) -> Relation:
        """v(): all. v(x): type tree or type, key, index term, type by scan. v(k1, k2, ..): keys, or a field and values."""
        g = self.graph
        if not words:
            return g.vertex_relation()
        if len(words) == 1:
            name = words[0]
            kinds = g.closure("V", name)
            if len(kinds) > 1 or name in g.typed:
                return g.vertex_relation([k for k in kinds if k in g.typed] if g.typed else kinds)
            if self._key_exists(name):
                return self._by_keys([name])
            if g.postings is not None and g.vertices.where(F.col("type") == name).limit(1).count() == 0:
                return keysets.fetch(g.postings, name)
            return g.vertex_relation([name])
        if self._key_exists(words[0]):
            return self._by_keys(words)
        rel = g.load(g.vertex_relation(), [words[0]])
        test = F.lit(False)
        for value in words[1:]:
            test = test | glob(rel.field(words[0]), value)
        return rel.with_df(rel.df.where(test))

    def _by_keys(self, keys: list[str]) -> Relation:
        kinds = {k.partition("/")[0] for k in keys}
        if self.graph.typed and kinds <= set(self.graph.typed):
            rel = self.graph.vertex_relation(sorted(kinds))
        else:
            rel = self.graph.vertex_relation()
        return rel.with_df(rel.df.where(F.col("key").isin(keys)))

    def keyset(self, x) -> Relation:
        """An operand of the set language: an index term unless it is a set already."""
        if isinstance(x, Relation):
            return x
        if isinstance(x, Token) and x.text in self.memo:
            return self.memo[x.text]
        if isinstance(x, list):
            raise QuerySyntaxError("a list is no keyset")
        return keysets.fetch(self._postings(), x.text)

    def _postings(self):
        if self.graph.postings is None:
            raise QuerySyntaxError("nothing is indexed")
        return self.graph.postings

    def operand(self, x, dialect: str) -> Relation:
        return self.keyset(x) if dialect == "set" else self.resolve(x)

    def push(self, rel: Relation) -> None:
        self.stack.append(rel)

    def link(self, before: Graph, rel: Relation) -> None:
        """Keeps the edges of rel that were not in the graph before."""
        self.links.append(rel.df.join(before.edges.select(F.col("edge_id").alias("key")), "key", "left_anti"))

    def filter(self, test: Callable[[Relation], object], *names: str) -> None:
        rel = self.graph.load(self.current(), list(names))
        self.push(rel.with_df(rel.df.where(test(rel))))


def _pair(words: list, op: str) -> tuple[str, str]:
    if len(words) < 2:
        raise QuerySyntaxError(f"{op} takes a field and a value")
    return words[0], words[1]


STEPS: dict[str, Callable[[Context, str, str], None]] = {}


def step(*names: str):
    def keep(fn):
        for n in names:
            STEPS[n] = fn
        return fn

    return keep


@step(".", "break")
def _nothing(c, op, dialect):
    pass


@step("note")
def _note(c, op, dialect):
    c.words()


@step(",")
def _list(c, op, dialect):
    b, a = c.pop(","), c.pop(",")
    c.stack.append([*(a if isinstance(a, list) else [a]), *(b if isinstance(b, list) else [b])])


@step("v")
def _v(c, op, dialect):
    c.push(c.vertices(c.texts()))


@step("e")
def _e(c, op, dialect):
    words = c.texts()
    if not words and c.stack and isinstance(c.stack[-1], Relation):
        return  # passes a set through
    c.push(tr.edge_scan(c.graph, words))


@step("has", "hasnot", "missing", "hastoken", "missingtoken")
def _has(c, op, dialect):
    name, value = _pair(c.texts(), op)
    test = lambda rel: F.coalesce(glob(rel.field(name).cast("string"), value), F.lit(False))
    c.filter(test if op in ("has", "hastoken") else lambda rel: ~test(rel), name)


@step("haslabel", "missinglabel")
def _label(c, op, dialect):
    (name,) = c.texts()
    c.filter(lambda rel: rel.field(name).isNotNull() if op == "haslabel" else rel.field(name).isNull(), name)


@step("between", "contains")
def _range(c, op, dialect):
    words = c.texts()
    if dialect == "set":
        field_, value = (c.pop(op).text, words[0]) if len(words) == 1 else words[:2]
        rows = c._postings().where(F.col("field") == field_.upper())
        if op == "contains":
            rows = rows.where(F.contains(F.col("token"), F.lit(value.upper())))
        else:
            rows = rows.where(F.substring("token", 1, 1).between("0", "9") & token_number(F.col("token")).between(float(words[1]), float(words[2])))
        c.push(Relation(rows.groupBy("key", "kind").agg(F.sum("score").alias("score")), POSTING))
        return
    if op == "contains":
        name, value = _pair(words, op)
        c.filter(lambda rel: F.coalesce(F.contains(rel.field(name).cast("string"), F.lit(value)), F.lit(False)), name)
    else:
        name, low, high = words
        value = lambda rel: F.coalesce(rel.field(name), F.lit(0)) if rel.is_numeric(name) else atof(F.coalesce(rel.field(name), F.lit("0")))
        c.filter(lambda rel: value(rel).between(float(low), float(high)), name)


@step(*COMPARISONS)
def _compare(c, op, dialect):
    words = c.texts()
    if op == "=" and dialect == "set":
        raise QuerySyntaxError("= stores nothing; use == to compare")
    if len(words) == 1 and c.stack and isinstance(c.stack[-1], Token):
        words = [c.stack.pop().text, *words]
    name, value = _pair(words, op)
    if dialect == "set":
        c.push(keysets.fetch(c._postings(), value, name, op))
    else:
        c.filter(lambda rel: compare(op, rel.field(name), value, rel.is_numeric(name)), name)


@step("where")
def _where(c, op, dialect):
    (body,) = c.words()
    rel = c.graph.load(c.current(), words_of(body.body))
    _, value, truth = compile_object(rel, body.body)
    c.push(rel.with_df(rel.df.where(value if truth else value.cast("double") != 0)))


@step("property")
def _property(c, op, dialect):
    words = c.words()
    rel = c.current()
    if words and isinstance(words[0], Token):
        rel = c.graph.load(rel, words_of(words[0].body))
        target, value, _ = compile_object(rel, words[0].body)
        if target is None:
            raise QuerySyntaxError("property{field = expression}")
        new = F.format_string("%.6f", value) if dict(rel.df.select(value.alias("x")).dtypes)["x"] == "double" else value.cast("string")
        c.graph = mutate.set_properties(c.graph, rel.df, {target: new}, rel.df)
        rel = rel.with_df(rel.df.withColumn(target, new)) if not rel.has_column("props") else rel.with_df(rel.df.withColumn("props", F.map_concat(F.map_filter("props", lambda k, v: k != target), F.create_map(F.lit(target), new))))
    else:
        names = words[0::2]
        values = {n: (words[2 * i + 1] if 2 * i + 1 < len(words) else None) for i, n in enumerate(names)}
        c.graph = mutate.set_properties(c.graph, rel.df, values)
        rel = Relation(rel.df.select("key"), rel.kind, rel.types)
    c.wrote = True
    c.push(rel)


def _sided(op: str) -> str:
    """The end that a step gives: as its name says."""
    if "inout" in op:
        return tr.BOTH
    return tr.OUT if op.startswith(("out", "object", "hasout", "fuseout", "issubject")) else tr.IN


@step("out", "objects", "in", "subjects", "inout")
def _hop(c, op, dialect):
    words = c.texts()
    c.push(tr.neighbours(c.graph, c.current(), words, _sided(op), c.strict))
    c.include, c.exclude, c.cost = [], [], None


@step("outedge", "oute", "inedge", "ine", "inoutedge", "inoute", "objecttriplets", "subjecttriplets", "outt", "int", "inoutt", "outtriplet", "intriplet", "inouttriplet")
def _triplets(c, op, dialect):
    words = c.texts()
    c.push(tr.triplets(c.graph, c.current(), words, _sided(op), strict=c.strict))


@step("hasout", "issubject", "hasin", "isobject", "hasinout")
def _having(c, op, dialect):
    words = c.texts()
    c.push(tr.having(c.graph, c.current(), words, _sided(op)))


@step("fuseout", "fusein", "fuseinout")
def _fuse(c, op, dialect):
    words = c.texts()
    c.push(tr.fuse(c.graph, c.current(), words, _sided(op.replace("fuse", ""))))


@step("by")
def _by(c, op, dialect):
    (name,) = c.texts()
    c.push(keysets.group_by(c.graph.load(c.current(), [name]), name))


@step("trend_slope")
def _trend(c, op, dialect):
    (body,) = c.words()
    target, names = fields_of(body.body)
    rel = c.graph.load(c.current(), names)
    values = [F.coalesce(rel.field(n), F.lit(0)).cast("double") if rel.is_numeric(n) else atof(F.coalesce(rel.field(n), F.lit("0"))) for n in names]
    c.push(rel.with_df(rel.df.withColumn(target or "trend", trend(values))))


@step("select")
def _select(c, op, dialect):
    c.select += c.texts()


def _two(c: Context, op: str, dialect: str) -> tuple[Relation, Relation]:
    b = c.pop(op)
    if isinstance(b, list) and op in ("join", "merge"):
        out = [c.operand(x, dialect) for x in b]
        return out[0], out[1]
    a = c.pop(op)
    return c.operand(a, dialect), c.operand(b, dialect)


@step("|", "||", "or", "join")
def _or(c, op, dialect):
    c.push(keysets.union(*_two(c, op, dialect)))


@step("&", "&&", "and", "merge")
def _and(c, op, dialect):
    c.push(keysets.intersection(*_two(c, op, dialect)))


@step("|&", "xor")
def _xor(c, op, dialect):
    c.push(keysets.symmetric_difference(*_two(c, op, dialect)))


@step("!", "not")
def _not(c, op, dialect):
    c.push(keysets.difference(*_two(c, op, dialect)))


@step("+", "-", "*", "/", "sqrt", "pow")
def _arithmetic(c, op, dialect):
    raise QuerySyntaxError(f"{op} stands inside {{}} only")


@step("as")
def _as(c, op, dialect):
    (name,) = c.texts()
    rel = c.current()
    c.memo[name] = rel
    c.push(rel)


@step("use")
def _use(c, op, dialect):
    (name,) = c.texts()
    c.push(c.memo[name] if name in c.memo else c.vertices([name]))


@step("reset")
def _reset(c, op, dialect):
    c.stack.clear()


@step("pushdup")
def _dup(c, op, dialect):
    c.stack.append(c.stack[-1])


@step("pop")
def _pop(c, op, dialect):
    c.pop(op)


@step("include", "incl", "exclude", "excl")
def _scope(c, op, dialect):
    (c.include if op.startswith("incl") else c.exclude).extend(c.texts())


@step("minimize", "maximize")
def _cost(c, op, dialect):
    (c.cost,) = c.words()
    c.maximize = op == "maximize"


def _cost_column(c: Context):
    if c.cost is None:
        return None
    edges = Relation(c.graph.edges.withColumnRenamed("edge_id", "key"), EDGE)
    if isinstance(c.cost, str):
        value = F.col("weight") if c.cost == "weight" else atof(edges.field(c.cost))
        return F.when(value != 0, value).otherwise(F.lit(1.0))
    return compile_object(edges, c.cost.body)[1].cast("double")


@step("match", "nomatch")
def _match(c, op, dialect):
    words = c.stack.pop() if c.stack and isinstance(c.stack[-1], list) else []
    sets = [c.resolve(x) for x in words]
    while len(sets) < 2:
        sets.insert(0, c.current())
    frames = [s.keys() for s in sets]
    if op == "match":
        c.push(paths.match(c.graph, frames, c.include, c.exclude, _cost_column(c), c.maximize, c.max_hops))
    else:
        c.push(paths.nomatch(c.graph, *frames[:2], c.include, c.exclude))
    c.include, c.exclude, c.cost, c.maximize = [], [], None, False


@step("addvertex", "addv")
def _addv(c, op, dialect):
    key, kind = _pair(c.texts(), op)
    c.graph, c.wrote = mutate.add_vertex(c.graph, key, kind), True
    c.push(c._by_keys([key]))


def _commit(c: Context) -> bool:
    e = c.edge
    if e is None or e.subject is None or e.object is None:
        return False
    before = c.graph
    c.graph, rel = mutate.add_edges(c.graph, mutate.pairs(e.subject.keys(), e.object.keys()), e.predicate, e.inverse)
    c.edge, c.wrote = None, True
    c.link(before, rel)
    c.push(rel)
    return True


@step("predicate", "adde", "addedge", "triplet")
def _add_edge(c, op, dialect):
    words = [x for x in c.words()]
    if not words:
        raise QuerySyntaxError(f"{op} takes a predicate")
    if isinstance(words[0], str) and words[0].startswith("@"):
        name, predicate = words[0][1:] or words[1], words[1]
        rest = words[2:]
        weight = F.lit(float(rest.pop())) if rest and rest[-1].replace(".", "", 1).isdigit() else None
        rel = c.graph.load(c.current(), [name])
        rows = mutate.edges_from_property(c.graph, rel, name)
        before = c.graph
        c.graph, made = mutate.add_edges(c.graph, rows, predicate, rest[0] if rest else None, weight)
        c.wrote = True
        c.link(before, made)
        c.push(rel if rel.kind != EDGE else made)
        return
    if len(words) >= 3:
        weight = F.lit(float(words.pop())) if isinstance(words[-1], str) and words[-1].replace(".", "", 1).isdigit() and len(words) > 3 else None
        subject, predicate, *inverse, obj = words
        pairs = mutate.pairs(c.resolve(subject).keys(), c.resolve(obj).keys())
        before = c.graph
        c.graph, rel = mutate.add_edges(c.graph, pairs, predicate, inverse[0] if inverse else None, weight)
        c.wrote = True
        c.link(before, rel)
        c.push(rel)
        return
    c.edge = PendingEdge(words[0], words[1] if len(words) > 1 else None)
    if c.stack and isinstance(c.stack[-1], Relation) and c.stack[-1].kind == VERTEX:
        c.edge.subject = c.stack.pop()  # a set before predicate() is the subject until subject() names another


@step("subject", "from", "object", "to")
def _end(c, op, dialect):
    words = c.words()
    side = "subject" if op in ("subject", "from") else "object"
    if c.edge is None:
        c.push(tr.endpoints(c.graph, c.current(), side))
        return
    rel = c.resolve(words[0]) if words else c.current()
    setattr(c.edge, side, rel)
    _commit(c)


@step("drop")
def _drop(c, op, dialect):
    rel = c.current()
    c.graph, c.wrote = mutate.drop(c.graph, rel.keys()), True
    c.push(Relation(rel.keys().limit(0)))


@step("renamekeys", "swapkeys")
def _rename(c, op, dialect):
    a, b = _pair(c.texts(), op)
    c.graph, c.wrote = mutate.rename(c.graph, {a: b} | ({b: a} if op == "swapkeys" else {})), True
    c.push(Relation(c.graph.vertices.select(F.col("id").alias("key")).limit(0)))


@step("redis")
def _action(c, op, dialect):
    words = c.texts()
    if len(words) < 3 or words[0].lower() != "rpush":
        raise QuerySyntaxError("only rpush of a row to a queue is supported")
    rel = c.current()
    c.queues.append((words[1], rel, words[2].lower()))
    c.push(rel)


def run(c: Context, postfix: list[Token], dialect: str) -> Relation:
    """The last set on the stack."""
    for token in postfix:
        if token.kind != "operator":
            c.stack.append(token)
        elif token.text in c.extra:
            c.extra[token.text](c, token.text, dialect)
        elif token.text in STEPS:
            STEPS[token.text](c, token.text, dialect)
        else:
            raise QuerySyntaxError(f"{token.text} is no operator")
    if not c.stack:
        if c.edge is not None:
            raise QuerySyntaxError(f"{c.edge.predicate} lacks a subject or object")
        raise QuerySyntaxError("Invalid expression, no result yielded!")
    if len(c.stack) > 1:
        log.warning("%d sets are left; the last one is the result", len(c.stack))
    return c.operand(c.stack[-1], dialect)


__all__ = ["Context", "GROUP", "TRIPLET", "run", "step"]
