"""The analysers, index terms and their upkeep."""

import pytest

from keyloom.engine import Engine
from keyloom.functions import analyse
from keyloom.sources.changes import last_state
from keyloom.sources.graph import CHANGES, DOCUMENTS, POSTINGS, Graph
from keyloom.streaming.buckets import bucket_averages, running_average, shift_register
from keyloom.streaming.index import Indexer, add, remove


def engine(spark, rows):
    e = Engine(spark, Graph.of(spark, documents=spark.createDataFrame(rows, DOCUMENTS)))
    e.reindex()
    return e


@pytest.fixture()
def places(spark):
    return engine(spark, [("louvre", "H", None, {"categories": "museum,science,nature", "year_founded": "1793"}), ("zoo", "H", None, {"categories": "nature", "year_founded": "1950"})])


def test_comma_list_scores_one_each(places):
    got = {r.key: round(r.score, 6) for r in places.query("science nature ranked").collect()}
    assert got == {"louvre": 2.0, "zoo": 1.0}
    assert [r.key for r in places.query("science nature ranked").collect()] == ["louvre", "zoo"]


def test_bands_and_comparisons(places):
    assert [r.key for r in places.query("science nature over 1.5").collect()] == ["louvre"]
    assert [r.key for r in places.query("science nature under 1").collect()] == ["zoo"]
    assert [r.key for r in places.query("nature & year_founded < 1900").collect()] == ["louvre"]
    assert sorted(r.key for r in places.query("year_founded != 1950").collect()) == ["louvre"]


def test_labels_numbers_phrases_and_json(spark):
    e = engine(spark, [("un", "S", 'HQ: New York. Established: 1945. "united nations" 3.5', None), ("j", "S", '{"a": {"name": "Ann Lee"}, "tags": ["x", "y"]}', None)])
    rows = {(r.key, r.field, r.token): r.score for r in e.graph.postings.collect()}
    assert rows[("un", "HQ", "NEW")] == 0.5 and rows[("un", "ESTABLISHED", "1945")] == 1.0
    assert ("un", "*", "UNITED NATIONS") in rows and ("un", "*", "3.5") in rows
    assert rows[("j", "NAME", "ANN")] == 0.5 and rows[("j", "TAGS", "X")] == 1.0
    assert [r.key for r in e.query("new & york").collect()] == ["un"]


def test_repeats_divide_by_the_square(spark):
    e = engine(spark, [("d", "S", "a b. a", None)])
    assert {r.token: r.score for r in e.graph.postings.collect()} == {"A": 1.5 / 4, "B": 0.5}
    assert analyse.postings(e.graph.documents, "unweighted").where("token = 'A'").first().score == 1.5


def test_tokens_have_no_exponent(spark):
    """A hash in quotes, such as 1E1F, is no power of ten."""
    e = engine(spark, [("hash", "S", '"1E1F" "9E9"', None), ("eleven", "S", "11 95.5", None), ("long", "S", f'"{"7" * 400}"', None)])
    assert keys_of(e.query("between('*',10,20)")) == ["eleven"]
    assert keys_of(e.query("'*' >= 90")) == ["eleven", "long"] and keys_of(e.query("'*' < 9")) == ["hash"]


def keys_of(rows):
    return sorted(r.key for r in rows.collect())


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Exchange " in line]


def test_postings_are_not_shuffled(spark):
    """Texts go by key, once; the tokens of a key that stands in several rows still come together."""
    e = engine(spark, [("d", "S", "a b", None), ("d", "S", "a", {"x": "label"}), ("f", "S", "a", None)])
    made = analyse.tally(analyse.fields(e.graph.documents), 3)
    assert len(exchanges(made)) == 1 and "hashpartitioning(key#" in exchanges(made)[0] and "REPARTITION" in exchanges(made)[0]
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, analyse.tally(analyse.fields(e.graph.documents), 1).collect()))
    assert {(r.key, r.field, r.token): r.score for r in e.graph.postings.collect()} == {("d", "*", "A"): 1.5 / 4, ("d", "*", "B"): 0.5, ("d", "X", "LABEL"): 1.0, ("f", "*", "A"): 1.0}


def test_the_tally_of_tokens_drops_keys_first(spark):
    rows = analyse.fields(spark.createDataFrame([("d", "S", "a b", None), ("f", "S", "a", {"x": "a"})], DOCUMENTS))
    told = analyse.token_tally(rows)
    assert len(exchanges(told)) == 1 and "key" not in exchanges(told)[0]
    assert {(r.field, r.token): (r.n, r.weight) for r in told.collect()} == {("*", "A"): (2, 1.5), ("*", "B"): (1, 0.5), ("X", "A"): (1, 1.0)}


def test_nulls_and_empty(spark):
    assert engine(spark, [("d", "S", None, None), ("e", "S", "", None)]).graph.postings.count() == 0
    e = Engine(spark, Graph.of(spark, documents=spark.createDataFrame([], DOCUMENTS)))
    assert e.reindex().count() == 0


def test_streamed_upkeep(spark, tmp_path):
    """Files of changes go through a stream; a batch that runs again changes nothing."""
    from keyloom.sources.changes import stream

    feed = str(tmp_path / "feed")
    spark.createDataFrame([(1, "hset", "a", "H", {"f": "x"}), (2, "hset", "b", "H", {"f": "y"})], CHANGES).coalesce(1).write.mode("append").parquet(feed)
    keeper = Indexer(spark)
    query = keeper.on(stream(spark, feed), str(tmp_path / "cp"))
    try:
        keeper.wait()
        assert sorted(r.token for r in keeper.postings.collect()) == ["X", "Y"]
        spark.createDataFrame([(3, "hset", "a", "H", {"f": "z"}), (4, "del", "b", "H", None)], CHANGES).coalesce(1).write.mode("append").parquet(feed)
        keeper.wait()
    finally:
        query.stop()
    assert [r.token for r in keeper.postings.collect()] == ["Z"]
    assert not keeper.status()["active"]
    again = spark.createDataFrame([(3, "hset", "a", "H", {"f": "z"}), (4, "del", "b", "H", None)], CHANGES)
    keeper.apply(again, keeper.since)
    assert [r.token for r in keeper.postings.collect()] == ["Z"]


def test_json_of_any_depth(spark):
    deep = '{"end": "bottom"}'
    for k in range(40):
        deep = '{"k%d": [%s, 1.50, null, true]}' % (k, deep)
    e = engine(spark, [("d", "S", deep, None), ("bad", "S", '{"a": ', None)])
    rows = {(r.key, r.field, r.token) for r in e.graph.postings.collect()}
    assert ("d", "END", "BOTTOM") in rows and ("d", "K0", "1.50") in rows and ("d", "K39", "TRUE") in rows
    assert {r[0] for r in rows} == {"d"}


def test_last_state_of_fields(spark):
    feed = [
        (1, "hset", "a", "H", {"x": "1", "y": "2"}), (2, "hdel", "a", "H", {"x": None}), (3, "hsetnx", "a", "H", {"y": "9", "z": "3"}),
        (4, "set", "s", "S", {"*": "one"}), (5, "append", "s", "S", {"*": " two"}), (6, "append", "s", "S", {"*": " three"}),
        (7, "hset", "gone", "H", {"x": "1"}), (8, "hdel", "gone", "H", {"x": None}),
        (9, "hset", "old", "H", {"n": "5"}), (10, "rename", "old", "H", {"to": "mid"}), (11, "hset", "mid", "H", {"m": "6"}), (12, "rename", "mid", "H", {"to": "new"}), (13, "hset", "old", "H", {"again": "7"}),
        (14, "setnx", "s", "S", {"*": "lost"}), (15, "append", "fresh", "S", {"*": "text"}), (16, "get", "a", "H", {"x": "no"}),
    ]
    got = {r.key: None if r.deleted else r.fields for r in feed_state(spark, feed)}
    assert got == {"a": {"y": "2", "z": "3"}, "s": {"*": "one two three"}, "gone": None, "old": {"again": "7"}, "mid": None, "new": {"n": "5", "m": "6"}, "fresh": {"*": "text"}}
    after = feed_state(spark, [*feed, (20, "flushall", None, None, None), (21, "hset", "a", "H", {"q": "1"})])
    assert {r.key for r in after if not r.deleted} == {"a"} and next(r.fields for r in after if r.key == "a") == {"q": "1"}
    assert feed_state(spark, []) == []


def feed_state(spark, rows):
    return last_state(spark.createDataFrame(rows, CHANGES)).collect()


def test_upkeep_of_fields_over_batches(spark):
    keeper = Indexer(spark)
    batches = [[(1, "hset", "a", "H", {"f": "x", "g": "y"}), (2, "hset", "b", "H", {"f": "w"})], [(3, "hdel", "a", "H", {"f": None}), (4, "rename", "b", "H", {"to": "c"})]]
    for n, rows in enumerate(batches):
        keeper.apply(spark.createDataFrame(rows, CHANGES), n)
    assert sorted((r.key, r.token) for r in keeper.postings.collect()) == [("a", "Y"), ("c", "W")]
    keeper.apply(spark.createDataFrame([(9, "flushdb", None, None, None)], CHANGES), 2)
    assert keeper.postings.count() == 0


def test_single_postings_come_and_go(spark):
    at = spark.createDataFrame([("k", "H", "F", "T", 1.0), ("k", "H", "F", "U", 2.0)], POSTINGS)
    more = add(at, spark.createDataFrame([("k", "H", "F", "T", 5.0), ("m", "H", "F", "T", 1.0)], POSTINGS))
    assert sorted((r.key, r.token, r.score) for r in more.collect()) == [("k", "T", 5.0), ("k", "U", 2.0), ("m", "T", 1.0)]
    assert [r.key for r in remove(more, more.where("key = 'k'")).collect()] == ["m"]


def test_stored_terms_are_in_order(places):
    assert [r.key for r in places.query("science nature", ordered=True).collect()] == ["louvre", "zoo"]


def test_buckets(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:01:00", 2.0), (1, "2024-01-01 00:02:00", 4.0), (1, "2024-01-01 00:31:00", 9.0)], "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "value")
    out = shift_register(bucket_averages(rows)).orderBy("bucket").collect()
    assert [(r.x_0, r.x_1) for r in out] == [(3.0, None), (9.0, 3.0)]
    assert running_average(2.0, 2, 5.0) == (3.0, 3)
