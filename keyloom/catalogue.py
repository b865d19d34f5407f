"""Named queries over the driver's tables, with SQL that gives the same rows.

Each name holds the operators of one family; the traversal and set queries run through the engine as text.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import analyse
from .operators import paths
from .scratch import stored
from .sources import changes, loaders
from .sources.graph import CHANGES, Graph, driver_graph
from .streaming import buckets, index, rules

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _keep(name: str, fn: Query, sql: str | None = None) -> None:
    _QUERIES[name] = fn
    if sql:
        _SQL[name] = sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def _engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, driver_graph(spark, sf_dir), **options)


def _text(name: str, query: str, sql: str, post: Callable[[DataFrame], DataFrame] = lambda d: d, **options) -> None:
    """A query in the traversal language, run as text."""
    _keep(name, lambda spark, sf_dir: post(_engine(spark, sf_dir, **options).query(query)), sql)


_members = lambda d: d.select("key", F.array_join("members", ",").alias("members"))
_triplets = lambda d: d.select("subject", "object", F.round("length", 6).alias("length"), F.array_join(F.transform("path", lambda s: s["key"]), ">").alias("path"))
FLAGSHIP = "g:v(customer).has(c_mktsegment,'BUILDING').out(lives_in).select(n_name)"

#: The vertex and edge tables in SQL, for the statements that need them.
_V = "v AS (" + " UNION ALL ".join(f"SELECT '{t}/' || {k} AS key, '{t}' AS type FROM {table}" for t, k, table in (("region", "r_regionkey", "region"), ("nation", "n_nationkey", "nation"), ("customer", "c_custkey", "customer"), ("supplier", "s_suppkey", "supplier"), ("part", "p_partkey", "part"), ("order", "o_orderkey", "orders"))) + ")"
_FORWARD = {
    "in_region": ("has_nation", "SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o, 1.0::DOUBLE AS w FROM nation"),
    "lives_in": ("has_customer", "SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS o, 1.0::DOUBLE AS w FROM customer"),
    "based_in": ("has_supplier", "SELECT 'supplier/' || s_suppkey AS s, 'nation/' || s_nationkey AS o, 1.0::DOUBLE AS w FROM supplier"),
    "placed_by": ("placed", "SELECT 'order/' || o_orderkey AS s, 'customer/' || o_custkey AS o, 1.0::DOUBLE AS w FROM orders"),
    "contains": ("contained_in", "SELECT 'order/' || l_orderkey AS s, 'part/' || l_partkey AS o, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL"),
    "supplied_by": ("supplies", "SELECT 'part/' || l_partkey AS s, 'supplier/' || l_suppkey AS o, min(l_extendedprice)::DOUBLE AS w FROM lineitem GROUP BY ALL"),
}


def _e(*predicates: str) -> str:
    """edges e(edge_id, predicate, subject, object, w) with twins, of some predicates."""
    parts = []
    for p in predicates or _FORWARD:
        q, body = _FORWARD[p]
        parts.append(f"SELECT '{p}:' || s || ':' || o AS edge_id, '{p}' AS predicate, s AS subject, o AS object, w FROM ({body})")
        parts.append(f"SELECT '{q}:' || o || ':' || s AS edge_id, '{q}' AS predicate, o AS subject, s AS object, w FROM ({body})")
    return "e AS (" + " UNION ALL ".join(parts) + ")"


# -- scans
_text("flagship", FLAGSHIP, "SELECT DISTINCT 'nation/' || n_nationkey AS key, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
_text("v_all", "g:v()", f"WITH {_V} SELECT key FROM v")
_text("v_type", "g:v(supplier)", "SELECT 'supplier/' || s_suppkey AS key FROM supplier")
_text("v_key", "g:v('part/7')", "SELECT 'part/7' AS key FROM part WHERE p_partkey = 7")
_text("v_keys", "g:v('region/1','region/2','nation/3')", "SELECT unnest(['region/1', 'region/2', 'nation/3']) AS key")
_text("v_field_values", "g:v(c_mktsegment,'BUILD*','machinery')", "SELECT 'customer/' || c_custkey AS key FROM customer WHERE c_mktsegment LIKE 'BUILD%' OR c_mktsegment = 'MACHINERY'")
_text("e_all_count", "g:e()", f"WITH {_e()} SELECT predicate, count(*) AS n FROM (SELECT split_part(edge_id, ':', 1) AS predicate FROM e) GROUP BY ALL", lambda d: d.groupBy(F.substring_index("key", ":", 1).alias("predicate")).agg(F.count("*").alias("n")))
_text("e_predicate", "g:e(lives_in)", "SELECT 'lives_in:customer/' || c_custkey || ':nation/' || c_nationkey AS key FROM customer")
_text("e_super_predicate", "g:e(located)", f"WITH {_e('lives_in', 'based_in')} SELECT edge_id AS key FROM e WHERE predicate IN ('lives_in', 'based_in')")
_text("e_partial", "g:e(lives_in,'customer/1*')", "SELECT 'lives_in:customer/' || c_custkey || ':nation/' || c_nationkey AS key FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '1%'")
_text("type_tree_party", "g:v(party)", "WITH RECURSIVE t(k) AS (SELECT 'party' UNION ALL SELECT c.sub FROM t JOIN (VALUES ('party', 'customer'), ('party', 'supplier')) AS c(sup, sub) ON c.sup = t.k), " + _V + " SELECT key FROM v JOIN t ON v.type = t.k")
_text("implicit_scan", "g:haslabel(n_name).select(n_name)", "SELECT 'nation/' || n_nationkey AS key, n_name FROM nation")

# -- filters
_text("has_segment", "g:v(customer).has(c_mktsegment,'build*')", "SELECT 'customer/' || c_custkey AS key FROM customer WHERE lower(c_mktsegment) LIKE 'build%'")
_text("hasnot_segment", "g:v(customer).hasnot(c_mktsegment,BUILDING)", "SELECT 'customer/' || c_custkey AS key FROM customer WHERE c_mktsegment <> 'BUILDING'")
_text("hastoken_segment", "g:v(customer).hastoken(c_mktsegment,building)", "SELECT 'customer/' || c_custkey AS key FROM customer WHERE lower(c_mktsegment) = 'building'")
_text("haslabel", "g:v(party).haslabel(s_acctbal)", "SELECT 'supplier/' || s_suppkey AS key FROM supplier")
_text("missinglabel", "g:v(party).missinglabel(s_acctbal)", "SELECT 'customer/' || c_custkey AS key FROM customer")
for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    _text(f"cmp_{_op}", f"g:v(part).{_op}(p_size,25).select(p_size)", f"SELECT 'part/' || p_partkey AS key, CAST(p_size AS VARCHAR) AS p_size FROM part WHERE p_size {_sign} 25")
_text("cmp_infix", "g:v(order).(o_totalprice >= 200000)", "SELECT 'order/' || o_orderkey AS key FROM orders WHERE o_totalprice >= 200000")
_text("cmp_missing_is_zero", "g:v(party).lt(s_acctbal,100)", "SELECT 'customer/' || c_custkey AS key FROM customer UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal < 100")
_text("between_price", "g:v(order).between(o_totalprice,1000,50000)", "SELECT 'order/' || o_orderkey AS key FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
_text("contains_name", "g:v(part).contains(p_name,'widget').select(p_name)", "SELECT 'part/' || p_partkey AS key, p_name FROM part WHERE contains(p_name, 'widget')")
_text("where_expr", "g:v(part).where{p_retailprice / p_size > 50}.select(p_name)", "SELECT 'part/' || p_partkey AS key, p_name FROM part WHERE p_retailprice / p_size > 50")
_text("where_functions", "g:v(part).where{sqrt(p_retailprice) + pow(p_size,2) * 2 - 10 <= 500}", "SELECT 'part/' || p_partkey AS key FROM part WHERE sqrt(p_retailprice) + pow(p_size, 2) * 2 - 10 <= 500")
_text("where_and_text", "g:v(part).where{p_size > 10 and contains(p_name,widget)}", "SELECT 'part/' || p_partkey AS key FROM part WHERE p_size > 10 AND contains(p_name, 'widget')")
_text("select_missing", "g:v(party).select(s_name,c_name)", "SELECT 'supplier/' || s_suppkey AS key, s_name, '' AS c_name FROM supplier UNION ALL SELECT 'customer/' || c_custkey, '', c_name FROM customer")

# -- traversals
_text("out_nation", "g:v(customer).gt(c_acctbal,5000).out(lives_in)", "SELECT DISTINCT 'nation/' || c_nationkey AS key FROM customer WHERE c_acctbal > 5000")
_text("in_orders", "g:v(customer).gt(c_acctbal,9000).in(placed_by)", "SELECT 'order/' || o_orderkey AS key FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
_text("inout_region", "g:v(region).inout(in_region)", "SELECT DISTINCT unnest(['nation/' || n_nationkey, 'region/' || n_regionkey]) AS key FROM nation")
_text("out_incident", "g:v(nation).out(lives_in)", "SELECT DISTINCT 'nation/' || c_nationkey AS key FROM customer")
_text("out_strict", "g:v(nation).out(lives_in)", "SELECT 'x' AS key WHERE false", strict=True)
_text("out_any_predicate", "g:v('nation/3').out()", f"WITH {_e('in_region', 'lives_in', 'based_in')} SELECT DISTINCT object AS key FROM e WHERE subject = 'nation/3' OR object = 'nation/3'")
_text("two_hop_region", "g:v(customer).has(c_mktsegment,MACHINERY).out(lives_in).out(in_region).select(r_name)", "SELECT DISTINCT 'region/' || r_regionkey AS key, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'MACHINERY'")
_text("edge_subjects", "g:e(lives_in).subject", "SELECT 'customer/' || c_custkey AS key FROM customer")
_text("edge_objects", "g:e(lives_in).object", "SELECT DISTINCT 'nation/' || c_nationkey AS key FROM customer")
_text("has_out", "g:v(customer).hasin(placed_by).select(c_name)", "SELECT 'customer/' || c_custkey AS key, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_text("has_in", "g:v(part).hasout(supplied_by)", "SELECT 'part/' || p_partkey AS key FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
_text("has_inout", "g:v(nation).hasinout(based_in)", "SELECT 'nation/' || n_nationkey AS key FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
_text("out_triplets", "g:v(supplier).oute(based_in)", "SELECT 'supplier/' || s_suppkey AS subject, 'nation/' || s_nationkey AS object, 1.0::DOUBLE AS length, 'supplier/' || s_suppkey || '>based_in:supplier/' || s_suppkey || ':nation/' || s_nationkey || '>nation/' || s_nationkey AS path FROM supplier", _triplets)
_text("in_triplets", "g:v(region).ine(in_region)", "SELECT 'nation/' || n_nationkey AS subject, 'region/' || n_regionkey AS object, 1.0::DOUBLE AS length, 'nation/' || n_nationkey || '>in_region:nation/' || n_nationkey || ':region/' || n_regionkey || '>region/' || n_regionkey AS path FROM nation", _triplets)
_text("inout_triplets", "g:v(region).inoutt(in_region)", "SELECT 'nation/' || n_nationkey AS subject, 'region/' || n_regionkey AS object, 1.0::DOUBLE AS length, 'nation/' || n_nationkey || '>in_region:nation/' || n_nationkey || ':region/' || n_regionkey || '>region/' || n_regionkey AS path FROM nation", _triplets)
_text("fuse_out", "g:v(supplier).fuseout(based_in)", "SELECT 'supplier/' || s_suppkey AS subject, 'based_in' AS predicate, 'nation/' || n_nationkey AS object, s_name AS S_s_name, n_name AS O_n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", lambda d: d.select("subject", "predicate", "object", F.col("props")["S_s_name"].alias("S_s_name"), F.col("props")["O_n_name"].alias("O_n_name")))

# -- set algebra
_B, _M = "v(customer).has(c_mktsegment,BUILDING)", "v(customer).gt(c_acctbal,5000)"
_sb, _sm = "c_mktsegment = 'BUILDING'", "c_acctbal > 5000"
for _name, _op, _where in (("or", "|", f"{_sb} OR {_sm}"), ("and", "&", f"{_sb} AND {_sm}"), ("xor", "|&", f"({_sb}) <> ({_sm})"), ("not", "!", f"{_sb} AND NOT {_sm}")):
    _text(f"set_{_name}", f"g:{_B} {_op} ({_M})", f"SELECT 'customer/' || c_custkey AS key FROM customer WHERE {_where}")
_text("or_and_precedence", f"g:{_B} & ({_M}) | (v(customer).lt(c_acctbal,0))", f"SELECT 'customer/' || c_custkey AS key FROM customer WHERE {_sb} AND ({_sm} OR c_acctbal < 0)")
_text("as_use_and", "g:v(nation).in(lives_in).as(ws).has(c_mktsegment,BUILDING).in(placed_by).out(placed_by).use(ws) &", "SELECT DISTINCT 'customer/' || c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_text("merge_join_steps", "g:merge(v(party),v(supplier))", "SELECT 'supplier/' || s_suppkey AS key FROM supplier")

# -- grouping
_text("by_field", "g:v(customer).by(c_mktsegment)", "SELECT c_mktsegment AS key, string_agg(k, ',' ORDER BY k) AS members FROM (SELECT c_mktsegment, 'customer/' || c_custkey AS k FROM customer) GROUP BY ALL", _members)
_text("by_subject", "g:v(nation).oute(in_region).by(subject)", "SELECT 'nation/' || n_nationkey AS key, 'region/' || n_regionkey AS members FROM nation", _members)
_text("by_object", "g:v(nation).oute(in_region).by(object)", "SELECT o AS key, string_agg(s, ',' ORDER BY s) AS members FROM (SELECT 'region/' || n_regionkey AS o, 'nation/' || n_nationkey AS s FROM nation) GROUP BY ALL", _members)


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of each customer segment in five years, pivoted into fields of one vertex; the slope over them."""
    years = [1992, 1993, 1994, 1995, 1996]
    rows = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = rows.groupBy("c_mktsegment").agg(*[F.round(F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")).otherwise(0.0)), 2).alias(f"y{y}") for y in years])
    g = Graph.of(spark, wide.select(F.col("c_mktsegment").alias("id"), F.lit("segment").alias("type"), F.create_map().cast("map<string,string>").alias("props")), typed={"segment": wide.select(F.col("c_mktsegment").alias("key"), F.lit("segment").alias("type"), *[f"y{y}" for y in years])})
    out = Engine(spark, g).query("g:v(segment).trend_slope{trend = (y1992,y1993,y1994,y1995,y1996)}")
    return out.select("key", F.round("trend.slope", 2).alias("slope"), F.round("trend.intercept", 2).alias("intercept"))


_keep("trend_fields", _trend, "WITH t AS (SELECT c_mktsegment AS key, y.x AS x, round(sum(CASE WHEN year(o_orderdate) = 1992 + y.x THEN o_totalprice ELSE 0 END), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (SELECT unnest(range(5)) AS x) AS y GROUP BY ALL) SELECT key, round(regr_slope(v, x), 2) AS slope, round(regr_intercept(v, x), 2) AS intercept FROM t GROUP BY key")

# -- full text
_LABEL, _PREFIX, _TOKEN = analyse.LABEL.replace("'", "''"), analyse._PREFIX, analyse.TOKEN.replace("'", "''")
_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def _analyser_sql(source: str) -> str:
    """p(key, kind, field, token, w, n): the analyser over a relation f(key, kind, field, value)."""
    return (
        f"f AS ({source}), "
        "s0 AS (SELECT key, kind, field, unnest(regexp_split_to_array(regexp_replace(value, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[.;*]')) AS s FROM f WHERE value IS NOT NULL), "
        f"s1 AS (SELECT key, kind, field, s, regexp_extract(s, '{_LABEL}', 1) AS label FROM s0), "
        f"s2 AS (SELECT key, kind, label AS field, regexp_replace(s, '{_PREFIX}', '') AS t FROM s1 WHERE label <> '' UNION ALL SELECT key, kind, field, unnest(string_split(s, ',')) FROM s1 WHERE label = ''), "
        f"s3 AS (SELECT key, kind, {_UP.format('field')} AS field, list_filter(list_transform(regexp_extract_all(t, '{_TOKEN}'), lambda x: {_UP.format("replace(replace(x, chr(34), ''), chr(1), '.')")}), lambda x: x <> '') AS t FROM s2), "
        "s4 AS (SELECT key, kind, field, unnest(t) AS token, 1.0::DOUBLE / len(t) AS w FROM s3 WHERE len(t) > 0), "
        "p AS (SELECT key, kind, field, token, sum(w) AS w, count(*) AS n, sum(w) / (count(*) * count(*)) AS score FROM s4 GROUP BY ALL)"
    )


_DOCS = "SELECT 'doc/' || doc_id AS key, 'S' AS kind, '*' AS field, text AS value FROM documents UNION ALL SELECT 'doc/' || doc_id, 'S', 'lang', lang FROM documents UNION ALL SELECT 'doc/' || doc_id, 'S', 'source', source FROM documents"
_P = "WITH " + _analyser_sql(_DOCS)


#: Indexes that were stored in this session, by application and data; queries read them, as those of a running engine do.
_STORED: dict[tuple[str, str], DataFrame] = {}


def _indexed(spark: SparkSession, sf_dir: str) -> Engine:
    e, at = _engine(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if at in _STORED:
        e.use_index(_STORED[at])
    else:
        _STORED[at] = e.reindex()
    return e


def _ft(name: str, query: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _indexed(spark, sf_dir).query(query).select("key", "kind", F.round("score", 6).alias("score"))

    _keep(name, run, _P + sql)


_sum = lambda where: f"SELECT key, kind, sum(score) AS score FROM p WHERE {where} GROUP BY key, kind"
_out = lambda body, where="true": f" SELECT key, kind, round(score, 6) AS score FROM ({body}) WHERE {where}"
_keep("postings_weighted", lambda s, d: analyse.postings(driver_graph(s, d).documents).withColumn("score", F.round(F.col("score") + 1e-9, 6)), _P + " SELECT key, kind, field, token, round(score + 1e-9, 6) AS score FROM p")
_keep("postings_unweighted", lambda s, d: analyse.postings(driver_graph(s, d).documents, "unweighted").withColumn("score", F.round(F.col("score") + 1e-9, 6)), _P + " SELECT key, kind, field, token, round(w + 1e-9, 6) AS score FROM p")
_keep("token_tally", lambda s, d: analyse.token_tally(analyse.fields(driver_graph(s, d).documents)).select("field", "token", "n", F.round(F.col("weight") + 1e-9, 4).alias("weight")), _P + " SELECT field, token, CAST(sum(n) AS BIGINT) AS n, round(sum(w) + 1e-9, 4) AS weight FROM p GROUP BY ALL")
_ft("ft_term", "idiot", _out(_sum("token = 'IDIOT'")))
_ft("ft_glob", "'anti*'", _out(_sum("token LIKE 'ANTI%'")))
_ft("ft_field_eq", "lang == de", _out(_sum("field = 'LANG' AND token = 'DE'")))
_ft("ft_field_ne", "lang != de", _out(_sum("field = 'LANG' AND token <> 'DE'")))
_ft("ft_field_cmp", "'*' >= 90", _out(_sum("substr(token, 1, 1) BETWEEN '0' AND '9' AND coalesce(try_cast(regexp_extract(token, '^([0-9]+\\.?[0-9]*)', 1) AS DOUBLE), 0) >= 90")))
_ft("ft_or_ranked", "idiot moron ranked", _out(_sum("token IN ('IDIOT', 'MORON')")))
_ft("ft_and_over", "idiot & clown over 0.01", _out(f"SELECT a.key, a.kind, a.score + b.score AS score FROM ({_sum('token = ' + repr('IDIOT'))}) AS a JOIN ({_sum('token = ' + repr('CLOWN'))}) AS b ON a.key = b.key AND a.kind = b.kind", "score >= 0.01"))
_ft("ft_under", "the under 0.05", _out(_sum("token = 'THE'"), "score > 0 AND score <= 0.05"))
_ft("ft_not", "idiot ! clown", _out(_sum("token = 'IDIOT' AND key NOT IN (SELECT key FROM p WHERE token = 'CLOWN')")))
_ft("ft_precedence", "lang == en & idiot | clown", _out(f"SELECT a.key, a.kind, a.score + b.score AS score FROM ({_sum('field = ' + repr('LANG') + ' AND token = ' + repr('EN'))}) AS a JOIN ({_sum('token IN (' + repr('IDIOT') + ', ' + repr('CLOWN') + ')')}) AS b ON a.key = b.key AND a.kind = b.kind"))
_ft("ft_contains", "lang contains e", _out(_sum("field = 'LANG' AND contains(token, 'E')")))
_ft("ft_between", "between('*',10,20)", _out(_sum("field = '*' AND substr(token, 1, 1) BETWEEN '0' AND '9' AND coalesce(try_cast(regexp_extract(token, '^([0-9]+\\.?[0-9]*)', 1) AS DOUBLE), 0) BETWEEN 10 AND 20")))
_keep("describe", lambda s, d: _indexed(s, d).describe("d?", "LANG"), _P + " SELECT DISTINCT token, field FROM p WHERE field = 'LANG' AND token LIKE 'D_'")
_keep("fetch_values", lambda s, d: _indexed(s, d).query("idiot & clown", fetch_rows=True).select("key", F.col("value")["lang"].alias("lang"), F.length(F.col("value")["text"]).alias("n")), _P + " SELECT key, lang, CAST(length(text) AS INTEGER) AS n FROM documents JOIN (SELECT DISTINCT key FROM p WHERE token = 'IDIOT' INTERSECT SELECT DISTINCT key FROM p WHERE token = 'CLOWN') ON key = 'doc/' || doc_id")


def _json_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select(F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("key"), F.lit("S").alias("kind"), F.col("props").alias("text"), F.lit(None).cast("map<string,string>").alias("props"))
    return analyse.postings(e).withColumn("score", F.round("score", 6))


_keep("json_postings", _json_postings, "SELECT 'event/' || event_id AS key, 'S' AS kind, upper(k) AS field, json_extract_string(props, '$.' || k) AS token, 1.0::DOUBLE AS score FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")


# -- paths
def _pairs(d: DataFrame) -> DataFrame:
    return d.select("subject", "object", F.round("length", 4).alias("length"))


def _relax(edges: str, cost: str, sources: str, targets: str, rounds: int) -> str:
    return f"WITH RECURSIVE {edges}, h AS (SELECT a, b, min(w) AS w FROM (SELECT subject AS a, object AS b, {cost} AS w FROM e UNION ALL SELECT object, subject, {cost} FROM e) GROUP BY ALL), r(s, n, c, l) AS (SELECT k, k, 0.0::DOUBLE, 0 FROM (SELECT unnest({sources}) AS k) UNION ALL SELECT r.s, h.b, min(r.c + h.w), r.l + 1 FROM r JOIN h ON r.n = h.a WHERE r.l < {rounds} GROUP BY r.s, h.b, r.l) SELECT s AS subject, n AS object, round(min(c), 4) AS length FROM r WHERE n IN (SELECT unnest({targets})) AND s <> n GROUP BY s, n"


_S = lambda *n: "[" + ", ".join(f"'supplier/{x}'" for x in n) + "]"
_text("match_hops", "g:include(in_region,based_in).match(v('supplier/1','supplier/2','supplier/3'),v(region))", _relax(_e("in_region", "based_in"), "1.0::DOUBLE", _S(1, 2, 3), "['region/0', 'region/1', 'region/2', 'region/3', 'region/4']", 10), _pairs)
_text("match_weighted", "g:include(supplied_by).minimize(weight).match(v('supplier/1','supplier/2'),v('supplier/3','supplier/4','supplier/5'))", _relax(_e("supplied_by"), "w", _S(1, 2), _S(3, 4, 5), 8), _pairs)
_text("match_expression", "g:include(supplied_by).minimize{sqrt(pow(weight,2) + 100)}.match(v('supplier/1'),v('supplier/3','supplier/4'))", _relax(_e("supplied_by"), "sqrt(w * w + 100)", _S(1), _S(3, 4), 8), _pairs)
_text("match_exclude", "g:exclude(lives_in,placed_by,contains,supplied_by).match(v('supplier/1','supplier/2'),v(region))", _relax(_e("in_region", "based_in"), "1.0::DOUBLE", _S(1, 2), "['region/0', 'region/1', 'region/2', 'region/3', 'region/4']", 10), _pairs)
_text("nomatch", "g:include(in_region).nomatch(v(region),v('nation/1','nation/2','nation/3'))", "SELECT 'region/' || r_regionkey AS subject, 'nation/' || n_nationkey AS object FROM region, nation WHERE n_nationkey IN (1, 2, 3) AND n_regionkey <> r_regionkey", lambda d: d.select("subject", "object"))


def _path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path lengths are the sums of their increments."""
    d = _engine(spark, sf_dir).query("g:include(in_region,based_in).match(v(supplier),v(region))")
    return d.groupBy((F.round(paths.path_length(F.col("path")), 6) == F.round("length", 6)).alias("agrees")).agg(F.count("*").alias("n"))


_keep("path_lengths", _path_check, "SELECT true AS agrees, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_text("match_path", "g:include(in_region,based_in).match(v(supplier),v(region))", "SELECT 'supplier/' || s_suppkey AS subject, 'region/' || n_regionkey AS object, 2.0::DOUBLE AS length, 'supplier/' || s_suppkey || '>based_in:supplier/' || s_suppkey || ':nation/' || s_nationkey || '>nation/' || s_nationkey || '>in_region:nation/' || s_nationkey || ':region/' || n_regionkey || '>region/' || n_regionkey AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey", _triplets)
_text("nomatch_types", "g:include(in_region,based_in).nomatch(v(supplier),v(region))", "SELECT 'supplier/' || s_suppkey AS subject, 'region/' || r_regionkey AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey, region WHERE r_regionkey <> n_regionkey", lambda d: d.select("subject", "object"))
_text("multi_match", "g:include(in_region).match(v(nation),v(region),v(nation))", "SELECT 'nation/' || a.n_nationkey AS subject, 'nation/' || b.n_nationkey AS object, 2.0::DOUBLE AS length FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey", _pairs)
_text("maximize", "g:include(in_region,based_in).maximize(weight).match(v('supplier/1'),v(region))", "SELECT 'supplier/' || s_suppkey AS subject, 'region/' || n_regionkey AS object, 2.0::DOUBLE AS length FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1", _pairs)


# -- mutations
_EDGE = ("edge_id", "predicate", "subject", "object", "inverse_id", "round(weight, 6) AS weight")


def _after(query: str, what: str = "edges", where: str = "true") -> Query:
    """The edges or vertices of the whole graph once a write query has run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _engine(spark, sf_dir)
        e.query(query)
        if what == "edges":
            return e.graph.edges.selectExpr(*_EDGE).where(where)
        return e.graph.vertices.where(where)

    return run


_TWINS = " ".join(f"WHEN '{p}' THEN '{q}' WHEN '{q}' THEN '{p}'" for p, (q, _) in _FORWARD.items())
_WHOLE_E = "WITH " + _e() + f", t AS (SELECT edge_id, predicate, subject, object, CASE predicate {_TWINS} END AS q, round(w, 6) AS w FROM e)"
_keep("add_edge_pairs", _after("g:predicate(near,close_to).subject(v('nation/1','nation/2')).object(v(region))", where="predicate IN ('near', 'close_to')"), "WITH x AS (SELECT s, 'region/' || r_regionkey AS o FROM region, (SELECT unnest(['nation/1', 'nation/2']) AS s)) SELECT 'near:' || s || ':' || o AS edge_id, 'near' AS predicate, s AS subject, o AS object, 'close_to:' || o || ':' || s AS inverse_id, 1.0::DOUBLE AS weight FROM x UNION ALL SELECT 'close_to:' || o || ':' || s, 'close_to', o, s, 'near:' || s || ':' || o, 1.0 FROM x")
_keep("rename_vertex", _after("g:renamekeys('region/1','mars')"), _WHOLE_E + ", n AS (SELECT predicate, q, CASE subject WHEN 'region/1' THEN 'mars' ELSE subject END AS s, CASE object WHEN 'region/1' THEN 'mars' ELSE object END AS o, w FROM t) SELECT predicate || ':' || s || ':' || o AS edge_id, predicate, s AS subject, o AS object, q || ':' || o || ':' || s AS inverse_id, w AS weight FROM n")
_keep("swap_vertices", _after("g:swapkeys('region/1','region/2')", where="subject IN ('region/1', 'region/2')"), _WHOLE_E + ", n AS (SELECT predicate, q, CASE subject WHEN 'region/1' THEN 'region/2' ELSE 'region/1' END AS s, object AS o, w FROM t WHERE subject IN ('region/1', 'region/2')) SELECT predicate || ':' || s || ':' || o AS edge_id, predicate, s AS subject, o AS object, q || ':' || o || ':' || s AS inverse_id, w AS weight FROM n")
_keep("drop_vertex", _after("g:v('nation/3').drop()"), _WHOLE_E + " SELECT edge_id, predicate, subject, object, q || ':' || object || ':' || subject AS inverse_id, w AS weight FROM t WHERE 'nation/3' NOT IN (subject, object)")
_keep("add_vertex", lambda s, d: _after("g:addv('moon','region')", "vertices", "type = 'region'")(s, d).select("id", "type"), "SELECT 'region/' || r_regionkey AS id, 'region' AS type FROM region UNION ALL SELECT 'moon', 'region'")
_keep("set_property", lambda s, d: _after("g:v(nation).property(grade,a,n_regionkey,'')", "vertices", "type = 'nation'")(s, d).select("id", F.col("props")["grade"].alias("grade"), F.col("props")["n_regionkey"].isNull().alias("gone")), "SELECT 'nation/' || n_nationkey AS id, 'a' AS grade, true AS gone FROM nation")
_keep("property_expression", lambda s, d: _after("g:v(nation).property{double = n_regionkey * 2 + 1}", "vertices", "type = 'nation'")(s, d).select("id", F.col("props")["double"].alias("value")), "SELECT 'nation/' || n_nationkey AS id, printf('%.6f', (n_regionkey * 2 + 1)::DOUBLE) AS value FROM nation")


def _edges_from_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    home = F.concat(F.lit("region/"), F.col("props")["n_regionkey"])
    e.graph = e.graph.changed(vertices=e.graph.vertices.withColumn("props", F.when(F.col("type") == "nation", F.map_concat("props", F.create_map(F.lit("home"), home))).otherwise(F.col("props"))))
    e.query("g:v(nation).adde('@home',calls_home,home_of,2)")
    return e.graph.edges.selectExpr(*_EDGE).where("predicate IN ('calls_home', 'home_of')")


_keep("add_edge_from_property", _edges_from_property, "WITH x AS (SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o FROM nation) SELECT 'calls_home:' || s || ':' || o AS edge_id, 'calls_home' AS predicate, s AS subject, o AS object, 'home_of:' || o || ':' || s AS inverse_id, 2.0::DOUBLE AS weight FROM x UNION ALL SELECT 'home_of:' || o || ':' || s, 'home_of', o, s, 'calls_home:' || s || ':' || o, 2.0 FROM x")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    e.query("g:v(supplier).gt(s_acctbal,5000).redis(rpush,rich,'@key')")
    return e.queues["rich"]


_keep("queue_push", _queue, "SELECT 'rich' AS name, 'supplier/' || s_suppkey AS value FROM supplier WHERE s_acctbal > 5000")


def _parts(rows: DataFrame) -> DataFrame:
    """What an export names: the ids of entities and the ends of triplets."""
    j = lambda f: F.get_json_object("json", "$." + f)
    return rows.select("part", F.coalesce(j("iri"), F.concat_ws(":", j("predicate"), j("subject"), j("object"))).alias("name"))


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text of a region's surroundings, taken apart again."""
    text = loaders.subgraph(_engine(spark, sf_dir).graph, "region/1", 1)
    part = lambda name, what: text.select(F.lit(name).alias("part"), F.explode(F.from_json(F.get_json_object("json", "$." + what), "array<string>")).alias("json"))
    return _parts(part("entity", "entities").unionByName(part("triplet", "triplets")))


_NEAR = ", n AS (SELECT DISTINCT unnest([subject, object]) AS k FROM e WHERE subject = 'region/1' OR object = 'region/1')"
_DEEP = ", n0 AS (SELECT DISTINCT unnest([subject, object]) AS k FROM e WHERE subject = 'region/1' OR object = 'region/1'), n AS (SELECT DISTINCT unnest([subject, object]) AS k FROM e WHERE subject IN (SELECT k FROM n0) OR object IN (SELECT k FROM n0))"
_INSIDE = " SELECT 'entity' AS part, k AS name FROM n UNION ALL SELECT 'triplet', edge_id FROM e WHERE subject IN (SELECT k FROM n) AND object IN (SELECT k FROM n)"
_keep("subgraph_export", _export, "WITH " + _e() + _NEAR + _INSIDE)
_keep("subgraph_deep", lambda s, d: _parts(loaders.subgraph_rows(_engine(s, d).graph, "region/1", 2)), "WITH " + _e() + _DEEP + _INSIDE)


# -- loaders
def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as a delimited file and loaded again."""
    path = stored(spark.range(1)).inputFiles()[0].rpartition("/")[0] + "-tsv"
    _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("type"), F.col("s_name").alias("s.name"), F.col("s_acctbal").alias("acct-bal")).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    rows = loaders.load_text(spark, path)
    return rows.select("key", "type", F.col("props")["s_name"].alias("s_name"), F.col("props")["acct_bal"].cast("double").alias("acct_bal"))


_keep("load_text_roundtrip", _round_trip, "SELECT CAST(s_suppkey AS VARCHAR) AS key, 'supplier' AS type, s_name, s_acctbal AS acct_bal FROM supplier")


def _graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored(spark.range(1)).inputFiles()[0].rpartition("/")[0] + "-json"
    n = _read(spark, sf_dir, "nation")
    ends = F.struct(F.concat(F.lit("n"), F.col("n_nationkey")).alias("iri"), F.lit("nation").alias("type"), F.col("n_name").alias("name"))
    n.select(F.to_json(F.struct(ends.alias("subject"), F.struct(F.lit("part_of").alias("type"), F.lit("has").alias("inverse"), F.lit("0.5").alias("weight")).alias("predicate"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("object")))).write.mode("overwrite").text(path)
    g = loaders.load_graph_json(spark, path)
    return g.edges.select("edge_id", "inverse_id", "weight").join(g.vertices.select(F.col("id"), F.col("props")["name"].alias("name")), F.expr("split(edge_id, ':')[1] = id"), "left").select("edge_id", "inverse_id", "weight", "name")


_keep("load_graph_json", _graph_json, "WITH x AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS o, n_name FROM nation) SELECT 'part_of:' || s || ':' || o AS edge_id, 'has:' || o || ':' || s AS inverse_id, 0.5::DOUBLE AS weight, n_name AS name FROM x UNION ALL SELECT 'has:' || o || ':' || s, 'part_of:' || s || ':' || o, 0.5, NULL FROM x")


# -- changes, rules, time
def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    fields = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "logout", "del").otherwise("hset").alias("op"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), F.lit("H").alias("kind"), fields.alias("fields"))


_LAST = "WITH l AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id)"
_keep("change_feed_state", lambda s, d: changes.last_state(_feed(s, d)).select("key", "kind", "deleted", F.col("fields")["event_type"].alias("event_type")), _LAST + " SELECT 'user/' || user_id AS key, 'H' AS kind, event_type = 'logout' AS deleted, event_type FROM l")


def _upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed in two batches: the index must be as if only the last state of each key had been indexed."""
    feed = _feed(spark, sf_dir)
    keeper = index.Indexer(spark)
    keeper.apply(feed.where("seq % 2 = 0"), 0)
    keeper.apply(feed, 1)
    return keeper.postings.where("field = 'EVENT_TYPE'").withColumn("score", F.round("score", 6))


def _field_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands on single fields: purchases append to a log, logouts take the value out, a view puts it where
    nothing stands, searches put the type, everything else puts the value."""
    e = _read(spark, sf_dir, "events")
    value, kind = F.col("value").cast("string"), F.col("event_type")
    op = F.when(kind == "purchase", "append").when(kind == "logout", "hdel").when(kind == "view", "hsetnx").otherwise("hset")
    fields = F.when(kind == "purchase", F.create_map(F.lit("log"), F.lit("x"))).when(kind == "search", F.create_map(F.lit("kind"), kind)).otherwise(F.create_map(F.lit("value"), value))
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), F.lit("H").alias("kind"), fields.alias("fields"))


def _field_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda n: F.col("fields")[n].alias(n)
    return changes.last_state(_field_feed(spark, sf_dir)).select("key", "deleted", F.coalesce(F.length(F.col("fields")["log"]), F.lit(0)).alias("n_log"), f("kind"), f("value"))


_keep(
    "change_feed_fields",
    _field_state,
    "WITH v AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_type NOT IN ('purchase', 'search')), "
    "f AS (SELECT user_id, max(event_id) FILTER (event_type <> 'view') AS at, max_by(event_type, event_id) FILTER (event_type <> 'view') AS what, max_by(value, event_id) FILTER (event_type <> 'view') AS firm FROM v GROUP BY user_id), "
    "g AS (SELECT v.user_id, min_by(v.value, event_id) AS given FROM v JOIN f ON v.user_id = f.user_id WHERE event_type = 'view' AND (f.at IS NULL OR event_id > f.at) GROUP BY v.user_id), "
    "s AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_log, CASE WHEN count(*) FILTER (event_type = 'search') > 0 THEN 'search' END AS kind FROM events GROUP BY user_id), "
    "x AS (SELECT s.user_id, n_log, kind, CASE WHEN f.at IS NULL OR f.what = 'logout' THEN g.given ELSE f.firm END AS value FROM s LEFT JOIN f ON s.user_id = f.user_id LEFT JOIN g ON s.user_id = g.user_id) "
    "SELECT 'user/' || user_id AS key, n_log = 0 AND kind IS NULL AND value IS NULL AS deleted, CAST(n_log AS INTEGER) AS n_log, kind, CAST(value AS VARCHAR) AS value FROM x",
)


def _moved_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events put their value; then the first user's key is renamed, and what came before event 100 is flushed."""
    e = _feed(spark, sf_dir).where("op = 'hset'")
    cut = spark.createDataFrame([(100, "flushall", None, None, None), (1 << 40, "rename", "user/1", "H", {"to": "user/first"})], CHANGES)
    return changes.last_state(e.where("seq <> 100").unionByName(cut)).select("key", "deleted", F.col("fields")["event_type"].alias("event_type"))


_keep(
    "change_feed_moves",
    _moved_feed,
    "WITH l AS (SELECT user_id, max_by(event_type, event_id) FILTER (event_id > 100) AS event_type FROM events WHERE event_type <> 'logout' AND event_id <> 100 GROUP BY user_id) "
    "SELECT CASE user_id WHEN 1 THEN 'user/first' ELSE 'user/' || user_id END AS key, event_type IS NULL AS deleted, event_type FROM l WHERE user_id <> 1 OR event_type IS NOT NULL UNION ALL SELECT 'user/1', true, NULL FROM l WHERE user_id = 1",
)


def _tree_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    e.type_tree_add("anything", "party")
    e.type_tree_add("anything", "place")
    return e.query("g:v(anything)").select("key")


_keep("type_tree_add", _tree_add, "SELECT 'customer/' || c_custkey AS key FROM customer UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier UNION ALL SELECT 'region/' || r_regionkey FROM region UNION ALL SELECT 'nation/' || n_nationkey FROM nation")
_keep("index_upkeep", _upkeep, _LAST + " SELECT 'user/' || user_id AS key, 'H' AS kind, 'EVENT_TYPE' AS field, upper(event_type) AS token, 1.0::DOUBLE AS score FROM l WHERE event_type <> 'logout'")


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[rules.Rules, DataFrame]:
    state = changes.last_state(_feed(spark, sf_dir))
    g = Graph.of(spark, stored(state.select(F.col("key").alias("id"), F.lit("user").alias("type"), F.col("fields").alias("props"))))
    r = rules.Rules(Engine(spark, g))
    r.set("big", "ge(value,50)")
    r.set("clicker", "has(event_type,click)")
    return r, state.select("key")


def _rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, keys = _ruled(spark, sf_dir)
    return r.apply(keys)


def _rule_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, keys = _ruled(spark, sf_dir)
    r.apply(keys)
    return spark.createDataFrame([(x.name, x.applies, x.skips, x.hits, x.misses) for x in r.list()], "rule string, applies long, skips long, hits long, misses long")


_keep("rule_hits_batch", _rule_hits, _LAST + " SELECT 'user/' || user_id AS key, 'H' AS kind, 'big' AS rule, 1.0::DOUBLE AS score FROM l WHERE value >= 50 UNION ALL SELECT 'user/' || user_id, 'H', 'clicker', 1.0 FROM l WHERE event_type = 'click'")
_keep("rule_counters", _rule_counters, _LAST + " SELECT 'big' AS rule, count(*) AS applies, 0::BIGINT AS skips, count(*) FILTER (value >= 50) AS hits, count(*) FILTER (value < 50) AS misses FROM l UNION ALL SELECT 'clicker', count(*), 0::BIGINT, count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type <> 'click') FROM l")


def _event_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = buckets.shift_register(buckets.bucket_averages(_read(spark, sf_dir, "events")))
    return out.select(F.col("key").alias("user_id"), F.unix_timestamp("bucket").alias("bucket"), *[F.round(f"x_{k}", 6).alias(f"x_{k}") for k in range(5)])


_keep("event_buckets", _event_buckets, "WITH b AS (SELECT user_id, time_bucket(INTERVAL '15 minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS t, avg(value) AS x FROM events GROUP BY ALL) SELECT user_id, CAST(epoch(t) AS BIGINT) AS bucket, round(x, 6) AS x_0, " + ", ".join(f"round(lag(x, {k}) OVER w, 6) AS x_{k}" for k in range(1, 5)) + " FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t)")


def _custom_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)

    @e.step("starts", arity=2)
    def starts(df, name, prefix):
        return df.where(F.col(name).startswith(prefix))

    return e.query("g:v(part).starts(p_name,small).select(p_name)")


_keep("custom_step", _custom_step, "SELECT 'part/' || p_partkey AS key, p_name FROM part WHERE starts_with(p_name, 'small')")


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)

    def shout(batches):
        for b in batches:
            yield b.assign(loud=b["key"].str.upper())[["key", "loud"]]

    e.load_script("shout", shout, "key string, loud string")
    return e.eval_script("g:v(nation)", "shout")


_keep("script", _script, "SELECT 'nation/' || n_nationkey AS key, 'NATION/' || n_nationkey AS loud FROM nation")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["flagship"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

