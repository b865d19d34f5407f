"""Operators 1, 4, 5, 6, 7 and the pipeline."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import packing, quality, shuffle, supervised, toxicity, warc

from .helpers import awkward, docs

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")


# -- 1 and 5
def labelled(spark, n=300, seed=1):
    """Toxic: an insult. Rejected: shouting or one word over and over."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 120))]
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Moron,", "scum"]))
        t = " ".join(w)
        if bad:
            t = t.upper().replace(" ", "!! ") if rng.random() < 0.5 else " ".join([w[0]] * 40)
            toxic = toxic and "IDIOT" in t or toxic and t.isupper()
        rows.append((i, t))
        labels.append((i, int(not bad), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(got, truth, column):
    held = [(r.predicted, truth[r.doc_id][column]) for r in got if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held), len(held)


@pytest.mark.parametrize(("module", "column", "modulus", "out"), [(quality, 0, 4, 2), (toxicity, 1, 3, 1)])
def test_held_out_accuracy(spark, module, column, modulus, out):
    rows, labels, truth = labelled(spark)
    rows += [(i + 10_000 if i is not None else None, t) for i, t in awkward()]
    got = module.classify(docs(spark, rows, extra=True), labels).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == out) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    share, n = accuracy(got, {i: (q, t) for i, q, t in truth}, column)
    assert n > 50 and share >= 0.93
    by_text = {}
    for (i, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, "")))):
        by_text.setdefault(i, set()).add(r.score)
    assert all(len(v) == 1 for i, v in by_text.items() if i is not None)


@pytest.mark.parametrize("module", [quality, toxicity])
@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (4, 1, 1)], [(1, None, None)]])
def test_without_two_classes(spark, module, labels):
    df = docs(spark, awkward())
    got = module.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(awkward()) and len({round(r.score, 12) for r in got}) == 1
    assert module.classify(docs(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_pairs_of_terms_count():
    """Neither word alone is toxic; together they are. Only the interaction can tell."""
    rng = random.Random(2)
    texts, y = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["filler"] + ["vermin"] * a + ["group"] * b).encode())
        y.append(int(a and b))
    found = toxicity.features(texts)
    model = toxicity.train(found, [], np.array(y))
    both, one, other = model.logits([b"filler vermin group", b"filler vermin", b"group filler"])
    assert both > 2 and one < 0 and other < 0
    assert np.abs(model.v).max() > 0.1


def test_terms_that_tell_in_pairs_only():
    """One of two words is toxic, both or none aren't: each alone says nothing of the class. Words around are noise."""
    rng = random.Random(6)
    noise = [a + b for a in "bcdfghklmn" for b in "aeiou"]
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(noise, k=25) + ["vermin"] * a + ["group"] * b
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        y.append(int(a != b))
    model = toxicity.train(toxicity.features(texts[:1000]), [], np.array(y[:1000]))
    assert np.mean((model.logits(texts[1000:]) > 0) == np.array(y[1000:])) > 0.99


def test_logits_are_the_explicit_sum_over_pairs():
    rng = np.random.default_rng(3)
    texts = [b"", b"one two two three", b"three four", " \u00e9t\u00e9 one".encode()]
    rows = [np.unique(f) for f in toxicity.features(texts)]
    buckets = np.unique(np.concatenate(rows))[1:]  # one of the terms isn't in use
    model = toxicity.Machine(0.3, buckets.astype(np.int32), rng.normal(size=len(buckets)), rng.normal(size=(len(buckets), 4)))
    for x, got in zip(rows, model.logits(texts)):
        at = [int(np.searchsorted(buckets, f)) for f in x.tolist() if f in buckets]
        want = 0.3 + sum(model.w[i] for i in at) + sum(model.v[i] @ model.v[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert abs(got - want) < 1e-9


def test_quality_scores_are_the_mean_over_features():
    """Features by hand: words, pairs, letters in runs of four with a blank at the ends of words at most."""
    texts = ["", " \n", "one two  two", "\u00e9t\u00e9 \u65e5\u672c\u8a9e", "a", "for for for"]
    found = quality.features([t.encode() for t in texts])
    for t, f in zip(texts, found):
        words = t.split()
        runs = [s[k : k + 4] for s in (f" {w} " for w in words) for k in range(len(s) - 3)]
        assert len(f) == len(words) + max(0, len(words) - 1) + len(runs)
    alone = [set(f.tolist()) for f in quality.features([b"for for", b"bar bar", b"bar for"])]
    assert len(alone[0] & alone[1]) == 1 and not (alone[0] & alone[1] & alone[2])  # a word that follows itself
    shares = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    for f, z in zip(found, quality.logits((shares, 0.5), [t.encode() for t in texts])):
        assert abs(z - (0.5 + (np.mean([float(shares[i]) for i in f]) if len(f) else 0))) < 1e-6


def test_samples_keep_their_bound(spark):
    rows = [(i, f"text {i} {k}") for i in range(30) for k in range(5)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] * 3, "doc_id long, quality int, toxic int")
    got = supervised.training_sample(docs(spark, rows), labels, "toxic", 3, 1, 4).collect()
    assert len(got) == 8 and all(r.text.endswith(" 0") for r in got)


def test_stage_without_labels_keeps_all(spark):
    df = docs(spark, awkward(), extra=True)
    for labels in ([], [(4, 1, 1)], [(4, 0, 0), (300, 0, 0)]):
        assert quality.accepted(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == len(awkward())


# -- 4
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def made(i, url, html):
    """A record by hand."""
    body = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "")
    h = hashlib.md5(f"{i} {url or ''}".encode()).hexdigest()
    name = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_fixity(spark, tmp_path, compression):
    """Files on disk hold the records byte by byte, and faults in a stored replica are found."""
    rows = [(i, f"http://h/{i}", "<p>" + "\u00e9" * (i % 7) + "</p>") for i in range(0, 1200)] + [(5000, None, None), (None, "u", "h"), (-3, "v", "w"), ((1 << 53) + 1, "x", "y")]
    bad = {5, 257, 1199, 5000}
    other = [(i, u, (h or "") + "!" if i in bad else h) for i, u, h in rows]
    warc.write(pages(spark, other), str(tmp_path / "w"), compression)
    got = {r.page_id: r for r in warc.report(warc.leaves(pages(spark, rows)), warc.read(spark, str(tmp_path / "w"))).collect()}
    assert len(got) == 1203
    assert not any(got[i].intact for i in bad) and got[(1 << 53) + 1].file == 1 << 45
    at = 0
    for i in range(256):
        r, record = got[i], made(*rows[i])
        assert (r.start, r.size, r.digest) == (at, len(record), hashlib.sha256(b"\x00" + record).hexdigest())
        assert r.intact == (i < 5)  # one record grew, so all after it in its file lie elsewhere
        at += len(record)
    (part,) = (tmp_path / "w" / "file=0").glob("part-*")
    data = part.read_bytes()
    data = gzip.decompress(data) if compression == "gzip" else data
    assert data == b"".join(made(*x) for x in other[:256]) and [data[a:b] for a, b in warc.split(data)] == [made(*x) for x in other[:256]]


def test_fixity_descends_only_where_roots_differ(spark):
    rows = [(i, "u", "h") for i in range(600)]
    mine = warc.leaves(pages(spark, rows))
    same = warc.audit(mine, mine)
    assert same.bad.count() == 0 and same.rows.count() == 600 and same.root == same.other_root is not None
    found = warc.audit(mine, warc.leaves(pages(spark, [(i, "u", "H" if i in (300, 301, 310) else "h") for i in range(600)])))
    assert found.root == same.root != found.other_root
    assert sorted((r.file, r.place) for r in found.bad.collect()) == [(1, 44), (1, 45), (1, 54)]
    size = {i: len(made(*rows[i])) for i in range(600)}
    start = lambda i: sum(size[k] for k in range(256, i))
    assert sorted(map(tuple, found.ranges().select("file", "first", "last", "start", "stop").collect())) == [(1, 44, 45, start(300), start(302)), (1, 54, 54, start(310), start(311))]
    assert warc.report(warc.leaves(pages(spark, [])), warc.leaves(pages(spark, []))).count() == 0
    lost = warc.audit(mine, warc.leaves(pages(spark, rows[:-1]))).bad.collect()
    assert [(r.file, r.place) for r in lost] == [(2, 87)]


def test_fixity_of_awkward_tables(spark, tmp_path):
    """Repeated ids and rows, clashing columns, an empty archive, members of gzip, files that are cut short."""
    rows = pages(spark, [(1, "a", "x"), (1, "a", "x"), (1, "b", None), (2, None, "y")]).selectExpr("*", "1 AS file", "2 AS place", "3 AS digest", "4 AS r", "5 AS size")
    warc.write(rows, str(tmp_path / "w"))
    got = warc.report(warc.leaves(rows), warc.read(spark, str(tmp_path / "w"))).collect()
    assert len(got) == 4 and all(r.intact for r in got)
    warc.write(pages(spark, []), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    one, two = made(1, "a", "x"), made(2, "b", "y")
    for n, data in enumerate((gzip.compress(one) + gzip.compress(two), one + two, one + two[:-3], b"no warc", b"", gzip.compress(one)[:-9])):
        (tmp_path / "m" / f"file={n}").mkdir(parents=True)
        (tmp_path / "m" / f"file={n}" / "part-0.warc").write_bytes(data)
    found = {}
    for r in warc.read(spark, str(tmp_path / "m")).collect():
        found.setdefault(r.file, []).append((r.place, r.start, r.size))
    assert found[0] == found[1] == [(0, 0, len(one)), (1, len(one), len(two))] and found[2][1] == (1, len(one), len(two) - 3)
    assert found[3] == [(0, 0, 7)] and 4 not in found and len(found[5]) == 1


# -- 6
def test_merging_by_rank_is_proven_for_the_vocabulary():
    assert packing.ranked_vocabulary(WORDS)


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tok, mine = Tokenizer.from_file(WORDS), packing.Encoder(WORDS)
    rng = random.Random(4)
    texts = [t or "" for _, t in awkward()] + ["ﬁ İstanbul ΑΣ Σ", "á b", "naïve, café's don't it'S", "a\x0b,b <|endoftext|> x", "word.,!? 12a 3.5", "ẞ ß ǅ", "a b c\x85d"]
    texts += ["".join(rng.choice("abAB éß.,'!1 \n日́") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        assert mine(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def check_places(rows, size):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size
    return len(at)


def test_packing(spark):
    from tokenizers import Tokenizer

    tok, rows = Tokenizer.from_file(WORDS), awkward()
    got = packing.pack(docs(spark, rows, extra=True), WORDS, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            want.append((str(i), n, a, ids[a : a + 2048], zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, list(r.ids), r.ids_crc32) for r in got) == sorted(want)
    total = sum(len(w[3]) for w in want)
    assert check_places(got, 2048) <= -(-total // 2048) + 1
    assert packing.pack(docs(spark, []), WORDS).count() == 0


def test_search_empties_bins():
    """Best fit leaves three bins; one exchange makes two of them do."""
    bins = packing.best_fit({6: 2, 5: 2, 4: 2}, 15)
    found, _ = packing.local_search(bins, 15)
    assert sum(found.values()) == 2
    start = Counter({((7, 1), (2, 1)): 1, ((5, 1), (3, 1)): 1, ((3, 1),): 1})
    found, steps = packing.local_search(start, 10)
    assert sum(found.values()) == 2 and steps >= 1
    pieces = Counter()
    for kind, n in found.items():
        assert sum(a * k for a, k in kind) <= 10
        for a, k in kind:
            pieces[a] += k * n
    assert pieces == Counter({7: 1, 2: 1, 5: 1, 3: 2})


@pytest.mark.parametrize("seed", range(4))
def test_search_keeps_all_pieces(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 60) for _ in range(400))
    first = packing.best_fit(counts, 64)
    last, _ = packing.local_search(first, 64)
    for bins in (first, last, packing.packed_bins(counts, 64)):
        held = Counter()
        for kind, n in bins.items():
            assert sum(a * k for a, k in kind) <= 64
            for a, k in kind:
                held[a] += k * n
        assert held == counts
    assert sum(last.values()) <= sum(first.values())
    table = packing.placement(last)
    assert len(table) == sum(len(k) for k in last)


def test_parts_are_closed_by_the_search():
    """Parts leave underfull bins; exchanges bring the number down to what the tokens need."""
    rng = random.Random(11)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(3000))
    parts = packing.parts_of(counts)
    assert sum((Counter(p) for p in parts), Counter()) == counts
    start = sum((packing.best_fit(p, 2048) for p in parts), Counter())
    least = -(-sum(a * n for a, n in counts.items()) // 2048)
    found, steps = packing.local_search(start, 2048)
    assert sum(start.values()) > sum(found.values()) == least == sum(packing.packed_bins(counts, 2048).values()) and steps > 1
    squares = lambda bins: sum(n * packing._fill(k) ** 2 for k, n in bins.items())
    assert squares(found) > squares(start)


# -- 7
@pytest.mark.parametrize("bucket_bytes", [1 << 24, 20_000])
def test_shuffle(spark, tmp_path, bucket_bytes):
    rows = awkward() + [(10_000 + i, f"t{i}") for i in range(500)]
    df = docs(spark, rows)
    got = shuffle.shards(df.repartition(7), path=str(tmp_path / "a"), bucket_bytes=bucket_bytes).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    again = shuffle.shards(df.repartition(3), path=str(tmp_path / "b"), bucket_bytes=bucket_bytes).collect()
    place = lambda x: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in x)
    assert place(got) == place(again)
    other = shuffle.shards(df, seed=9, path=str(tmp_path / "c"), bucket_bytes=bucket_bytes).collect()
    assert place(got) != place(other)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None and r.doc_id >= 10_000]
    ranks = np.corrcoef(order, range(len(order)))[0, 1]
    assert abs(ranks) < 0.25


def test_shuffle_writes_whole_records(spark, tmp_path):
    df = docs(spark, awkward(), extra=True)
    shuffle.external_shuffle(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s")).select("row.*")
    assert df.columns == back.columns
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(t) for _, t in awkward())
    assert shuffle.shards(docs(spark, []), path=str(tmp_path / "e")).count() == 0


def test_many_equal_rows_fill_no_bucket(spark, tmp_path):
    rows = [(7, "the same text again")] * 3000 + [(i, f"other {i}") for i in range(3000)]
    df = docs(spark, rows).repartition(5)
    got = shuffle.shards(df, path=str(tmp_path / "h"), bucket_bytes=20_000).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 6000 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "h")).groupBy("bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1.6 * sum(sizes) / len(sizes)


# -- the pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels, truth = labelled(spark, 200)
    good = next(t for i, t in rows if truth[i][1] == 1 and len(t) > 300)
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(i, t) for i, t in rows] + [(900, good), (901, good + " " + item), (902, good + f" write to a.b{1}@mail.example.com now"), (903, None)]
    folder = str(tmp_path)
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "packing"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == columns
            now = spark.createDataFrame(seen[name], now.schema)
    assert len(seen["near_dedup"]) < len(seen["quality"]) < len(rows)
    assert not any(item in (r.text or "") for r in seen["decontaminate"])
    assert not any("@mail.example.com" in (r.text or "") for r in seen["pii"])
    assert check_places(seen["packing"], 2048) >= 1
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in seen["packing"])
