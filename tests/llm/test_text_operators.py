"""Operators 2, 3, 8, 9 and 10 against brute force, on awkward tables."""

import hashlib
import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import common, decontaminate, fingerprint, pii, simhash, substrings

from .helpers import DOCS, awkward, docs

SPACE = r"[^\x20\x09-\x0D]+"


def canon(text):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(text).casefold())).strip()


# -- 2
def edited(rows):
    """(id, text) -> the edited text, by brute force; for repeated ids the smallest text stands."""
    by_id = {}
    for i, t in rows:
        if i is not None:
            by_id[i] = min(by_id.get(i, t or ""), t or "")
    ids = sorted(by_id)
    out = []
    for i, t in rows:
        t = t or ""
        after = by_id[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else ""
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + after[:half], after))
    return out


def test_fingerprints(spark):
    rows = awkward()
    got = fingerprint.fingerprints(docs(spark, rows, extra=True)).collect()
    want = edited(rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(t) == canon(e)), float(canon(t) == canon(n))) for i, t, e, n in want)
    texts = {(r.doc_id, r.edited_sha256): r.fingerprint for r in got}
    by = {}
    for i, t, e, _ in want:
        by.setdefault(canon(t), set()).add(texts[i, hashlib.sha256(e.encode()).hexdigest()])
    assert all(len(x) == 1 for x in by.values())
    assert len(set().union(*by.values())) == len(by)


def test_fingerprint_folds(spark):
    got = fingerprint.fingerprints(docs(spark, [(1, "Ａé  ﬁ ß"), (2, "aé fi SS"), (3, "ae fi ss")])).orderBy("doc_id").collect()
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint


def test_equal_buckets_are_compared_byte_by_byte(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.struct(F.length(c).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo")))
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (700, "bb"), (701, None)]
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs(spark, rows)).collect()}
    assert got[1] == got[3] != got[2] == got[700] and len(set(got.values())) == 4


def test_fingerprint_of_nothing(spark):
    assert fingerprint.fingerprints(docs(spark, [])).count() == 0
    assert fingerprint.fingerprints(docs(spark, [(None, "a")])).first().near_edited == 1.0


def test_successors_over_wide_ids(spark):
    ids = sorted({random.Random(3).randrange(-(10**15), 10**15) for _ in range(300)} | set(range(700)))
    got = {r.doc_id: r.succ_id for r in fingerprint._digests(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


# -- 3
def removed(rows, n=20):
    """Brute force; rows with one id in the order of their texts' hashes, equal rows being one place."""
    order = {(i if i is not None else -(2**63), t or ""): None for i, t in rows}
    places = sorted(order, key=lambda x: (x[0], xxhash.xxh64_intdigest(x[1].encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(x[1].encode(), 42) >> 63)))
    seen, out = set(), {}
    for key in places:
        w = re.findall(SPACE, key[1])
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            if g in seen:
                gone[s : s + n] = [True] * n
            seen.add(g)
        out[key] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, z in zip(w, gone) if not z).encode()).hexdigest())
    return sorted((str(i), *out[i if i is not None else -(2**63), t or ""]) for i, t in rows)


def passages(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    shared = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    out = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(w))
            w[k:k] = rng.choice(shared)
        out.append((i, " ".join(w)))
    return [*out, (120, "la " * 90), (121, "ab cd " * 40), (122, out[3][1])]


@pytest.mark.parametrize("rows", [awkward(), passages()])
def test_substrings(spark, rows):
    got = substrings.report(docs(spark, rows, extra=True).repartition(5)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MAX_CELLS", 1 << 16)
    monkeypatch.setattr(substrings, "SKETCH_LOAD", 1 << 30)
    monkeypatch.setattr(substrings, "FLUSH", 500)
    rows = passages(2)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(docs(spark, rows)).collect()) == removed(rows)


def test_deduplicate_keeps_columns(spark):
    rows = [(1, " ".join(f"a{k}" for k in range(30))), (2, "first  " + " ".join(f"a{k}" for k in range(30)) + "\nlast"), (3, None)]
    df = docs(spark, rows, extra=True)
    got = substrings.deduplicate(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: rows[0][1], 2: "first  \nlast", 3: None}
    assert substrings.deduplicate(docs(spark, [])).count() == 0


# -- 8
def test_position_sets_cover():
    for bits in (0, 2, 4, 6):
        sets = simhash.position_sets(bits)
        assert all(any(set(s) <= set(c) for s in sets) for c in itertools.combinations(range(8), 8 - bits))


def by_hand(text, n=4):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, bits=4):
    """Smallest reachable id for each row, by brute force."""
    values = np.array([f for _, f in fps], np.uint64)
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= bits):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [min((fps[k][0] for k in range(len(fps)) if label[k] == label[i] and fps[k][0] is not None), default=None) for i in range(len(fps))]


@pytest.mark.parametrize("cap", [simhash.LIST_CAP, 2])
def test_components(spark, cap):
    rng = random.Random(5)
    rows = awkward()
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(400)]
    for i in range(60):
        w = list(base)
        w[rng.randrange(400)] = "new"
        rows.append((1000 + i, " ".join(w)))
    fps = [(i, by_hand(t)) for i, t in rows]
    got = simhash.simhash_components(docs(spark, rows, extra=True), list_cap=cap).collect()
    want = sorted((str(i), f"{f:016x}", str(g)) for (i, f), g in zip(fps, groups(fps)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_keep_one(spark):
    df = docs(spark, awkward(), extra=True)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(5) == 0 and 4 in ids and 7 in ids and ids.count(None) == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [(1, "a b"), (1, "a b")])).count() == 1
    assert [r.doc_id for r in simhash.keep_one(docs(spark, [(None, "a b"), (None, "a b")])).collect()] == [None]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rows = [(1, "one copied text of words"), (5, "one copied text of words"), (5, "another text, in no group"), (6, "a b c d"), (6, "x y z w q")]
    df = docs(spark, rows).selectExpr("*", "1 AS _gone", "2 AS _nth", "3 AS _row", "4 AS h", "5 AS node", "6 AS _maybe", "7 AS _w", "8 AS _at", "9 AS _b")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted({rows[0], *rows[2:]})


@pytest.mark.parametrize("options", [{}, {"list_cap": 2}])
def test_pipeline_stage_links_by_fingerprints_and_by_shingles(spark, options):
    """The stage keeps the smallest id of each component of both relations, each by brute force on its own. Words changed
    in texts that mostly repeat a line leave the fingerprint, but not the set of shingles; those scattered over prose don't
    leave the fingerprint."""
    import corpus_pipeline

    rng = random.Random(14)
    word = lambda: rng.choice("bcdfg") + str(rng.randint(0, 5000))
    rows = []
    for g in range(12):
        line = [word() for _ in range(7)] * 60
        rows += [(100 * g + c, " ".join(line + [word() for _ in range(12)])) for c in range(3)]
        base = [word() for _ in range(200)]
        rows.append((100 * g + 10, " ".join(base)))
        for c in range(11, 14):
            w = list(base)
            for k in rng.sample(range(200), 4):
                w[k] = word()
            rows.append((100 * g + c, " ".join(w)))
    prints = [(i, by_hand(t)) for i, t in rows]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    only_prints, only_sets, want = 0, 0, {i: i for i, _ in rows}
    for (a, x), (b, y) in itertools.combinations(sorted(prints), 2):
        by_print = (x ^ y).bit_count() <= 4
        by_set = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
        only_prints += by_print and not by_set
        only_sets += by_set and not by_print
        if (by_print or by_set) and want[a] != want[b]:
            low, high = sorted((want[a], want[b]))
            want = {i: low if r == high else r for i, r in want.items()}
    assert only_prints > 10 and only_sets > 10
    df = docs(spark, [*rows, (7000, rows[0][1]), (7001, None), (7002, " "), (7003, "")])
    got = simhash.keep_one(df, **options) if options else corpus_pipeline.near_dedup(spark, df, None)
    assert sorted(r.doc_id for r in got.collect()) == sorted({*want.values(), 7001})


def test_near_groups(spark):
    """Copies with 1 word in 100 changed (similarity 0.9) join; halves of one text (0.33) and strangers don't."""
    rng = random.Random(8)
    text = lambda n: [rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randint(0, 400)) for _ in range(n)]
    rows, n = [], 0
    for g in range(20):
        base = text(300)
        for c in range(4):
            w = list(base)
            for k in range(3 if c else 0):
                w[rng.randrange(300)] = f"new{g}{c}{k}"
            rows.append((100 * g + c, " ".join(w)))
        rows.append((100 * g + 50, " ".join(base[:150] + text(150))))
        n += 1
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs(spark, rows)).collect()}
    assert sum(got[100 * g + c] == 100 * g for g in range(n) for c in range(4)) >= 76
    assert all(got[100 * g + 50] == 100 * g + 50 for g in range(n))


def test_one_long_list(spark):
    """Many near copies of one text are one group, and few comparisons are needed for it."""
    rng = random.Random(9)
    base = [str(rng.randint(0, 9999)) for _ in range(200)]
    rows = [(i, " ".join(base[:k] + ["x" + str(i)] + base[k:])) for i, k in enumerate(rng.choices(range(200), k=400))]
    got = [r.component_id for r in simhash.near_groups(docs(spark, rows)).collect()]
    assert got.count(0) >= 396


@pytest.mark.parametrize("size", [1, 3, 4, 7, 50])
def test_lists_over_the_cap_go_over_any_batches(size):
    """All nodes of a long list are linked to its first one, wherever batches end; other lists are not touched."""
    rows = [(1, 1), (1, 2), *((5, k) for k in range(30)), (9, 1), (9, 2), *((11, k) for k in range(40, 60))]
    batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "node": [n for _, n in part]}) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
    got = [r for b in simhash._members(4)(iter(batches)) for r in b.to_pylist()]
    linked, names = {k: {k} for k in range(60)}, {}
    for r in got:
        names.setdefault(r["key"], []).append(r["node"])
    for nodes in names.values():
        for n in nodes:
            linked[nodes[0]].add(n)
    assert linked[0] == set(range(30)) and linked[40] == set(range(40, 60)) and 2 in linked[1]
    assert size == 50 or all(r["star"] in (0, 40) for r in got if r["node"] not in (1, 2))


def test_near_groups_with_lists_over_many_batches(spark):
    """Lists over the cap that fill several Arrow batches, as in large tables."""
    rng = random.Random(10)
    base = [str(rng.randint(0, 9999)) for _ in range(60)]
    rows = [(i, " ".join([*base, "x" + str(i)])) for i in range(90)] + [(1000 + i, " ".join(str(rng.randint(0, 9999)) for _ in range(60))) for i in range(20)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        got = {r.doc_id: r.component_id for r in simhash.near_groups(docs(spark, rows), list_cap=10).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {i: 0 if i < 90 else i for i, _ in rows}


@pytest.mark.parametrize("options", [{}, {"list_cap": 2}, {"group_bytes": 2000}, {"list_cap": 3, "group_bytes": 9000}])
def test_near_groups_are_those_of_brute_force(spark, options):
    """Changed words scattered over a text put pairs on both sides of 0.8; groups are those of the exact similarity."""
    rng = random.Random(12)
    rows = []
    for g in range(60):
        base = [rng.choice("bcdfg") + str(rng.randint(0, 3000)) for _ in range(rng.choice((40, 120, 300, 900)))]
        rows.append((10 * g, " ".join(base)))
        for c in range(1, 4):
            w = list(base)
            for k in rng.sample(range(len(w)), max(1, round(len(w) * rng.uniform(0.018, 0.035)))):
                w[k] = f"new{g}{c}{k}"
            rows.append((10 * g + c, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want, close = {i: i for i in sets}, 0
    for a, b in itertools.combinations(sorted(sets), 2):
        share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        close += 0.75 <= share < 0.85
        if share >= 0.8 and want[a] != want[b]:
            low, high = sorted((want[a], want[b]))
            want = {i: low if r == high else r for i, r in want.items()}
    assert close > 60
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs(spark, rows), **options).collect()} == want


# -- 9
def base_by_hand(t):
    def luhn(d):
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        return total % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["123.. 0@a+-(%_é\n", "12345678904-  +", "ab@.@-1"])
def test_base_spans_on_noise(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == base_by_hand(t), t


def test_long_runs_take_linear_time():
    for t in ("7" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" + "-" * 200_000):
        pii.base_spans(t)


def test_disclosing_terms(spark):
    """A word that stands by one address only, in three different contexts, gives it away; common words don't."""
    said = ["{} met zorblatt today at noon near bob@x.org and then {} left", "report {} says zorblatt wrote to bob@x.org about {} plans", "while {} slept zorblatt had bob@x.org copied {} again"]
    rows = [(i, s.format(f"filler{i}", f"other{i}")) for i, s in enumerate(said)]
    rows += [(10 + i, f"report today noon plans again {i} copied slept wrote") for i in range(40)]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows, extra=True)).collect()}
    for i, t in rows[:3]:
        at = t.index("zorblatt")
        assert f"term:{at}:{at + 8}" in got[i].spans.split(",") and got[i].n_email == 1
    assert not any("term" in got[10 + i].spans for i in range(40))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert all("zorblatt" not in clean[i] and "<EMAIL>" in clean[i] for i in range(3)) and clean[10] == rows[3][1]
    copies = [(i, rows[0][1]) for i in range(9)] + rows[3:]  # copies of one passage are one piece of evidence
    assert not any("term" in r.spans for r in pii.find(docs(spark, copies)).collect())


def test_terms_are_marked_in_all_places(spark):
    """A disclosing word far from the value, in short letters, and in documents without the value."""
    far = lambda i: " ".join("pad" + "".join(chr(97 + int(c)) for c in str(1000 * k + i)) for k in range(15))
    rows = [(i, f"{far(i)} Bo went {far(i + 50)} by bob@x.org {far(i + 99)}") for i in range(4)]
    rows += [(4, "bo is alone here")] + [(10 + i, f"nothing {far(200 + i)}") for i in range(400)]
    got = {r.doc_id: r.spans for r in pii.find(docs(spark, rows)).collect()}
    at = rows[0][1].index("Bo")
    assert f"term:{at}:{at + 2}" in got[0].split(",") and got[4] == "term:0:2" and got[10] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}  # 4 of 5 texts with the word hold the value
    assert clean[4] == "<TERM> is alone here" and " Bo " not in clean[1] and "<EMAIL>" in clean[1] and clean[10] == rows[5][1]


def test_copies_do_not_hide_a_term(spark):
    """Every text with the word holds the value; copies and near copies of one of them change nothing."""
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    said = [f"{letters(i)} saw zorblatt {letters(i + 20)} bob@x.org {letters(i + 40)}" for i in range(10, 13)]
    rest = [(1000 + i, f"plain {letters(2000 + i)} words saw") for i in range(500)]
    for more in ([said[0]] * 60, [f"{said[0]} end {letters(5000 + i)}" for i in range(60)]):
        got = {r.doc_id: r.spans for r in pii.find(docs(spark, [*enumerate([*said, *more]), *rest])).collect()}
        assert all(f"term:{t.index('zorblatt')}:" in got[i] for i, t in enumerate([*said, *more]))
        assert not any("term" in got[i] for i, _ in rest)


def test_letter_words():
    """Hashes and places are those of each word lowered on its own, with letters that lower to two or by their place."""
    texts = ["One twO_three4five  \u0130stanbul ΣΑΣ été", "", "7", "日本 STRASSE ß", "a" * 3, "Ǆ x\u0301y end"]
    got = []
    for low, hashes, doc, starts, ends in common.letter_words(texts * 2):
        got += list(zip((low + doc).tolist(), hashes.tolist(), starts.tolist(), ends.tolist()))
    want = [(i, common.word_hash(m[0].lower()), m.start(), m.end()) for i, t in enumerate(texts * 2) for m in re.finditer(r"[^\W\d_]+", t)]
    assert got == want and len({h for _, h, _, _ in want}) == len({m[0].lower() for t in texts for m in re.finditer(r"[^\W\d_]+", t)})


def test_disclosing_terms_are_those_of_brute_force(spark):
    """All counts, contexts and bits by hand, on a small vocabulary with copies; also a term in documents without values."""
    rng = random.Random(31)
    common, rare = [f"c{chr(97 + i)}" for i in range(12)], [f"r{chr(97 + i)}" for i in range(10)]
    rows = []
    for i in range(220):
        k = rng.randrange(14)
        words = rng.choices(common, k=rng.randint(4, 30))
        if k < 10:
            words.insert(rng.randrange(len(words)), rare[k])
            if rng.random() < 0.75:
                words.insert(rng.randrange(len(words)), f"user{k}@mail.org")
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rng.choice(rows)[1]) for i in range(60)]
    texts = sorted({t for _, t in rows})
    e_in, t_in, far, wide = {}, {}, {}, {}
    for n, text in enumerate(texts):
        words = text.split()
        plain = [w for w in words if "@" not in w]
        for t in set(plain):
            t_in.setdefault(t, set()).add(n)
        for e in {w for w in words if "@" in w}:
            e_in.setdefault(e, set()).add(n)
            near = []
            for k, w in enumerate(words):
                if w == e:
                    near.append((tuple(x for x in words[:k] if "@" not in x)[-10:], tuple(x for x in words[k:] if "@" not in x)[:10]))
            far.setdefault(e, {}).setdefault(n, tuple(near))
            for t in set(plain):
                k = plain.index(t)
                wide.setdefault((e, t), {})[n] = tuple(plain[max(0, k - 10) : k + 11])
    terms = set()
    for e in e_in:
        for t in t_in:
            both = e_in[e] & t_in[t]
            if both and len({far[e][n] for n in both}) >= 3 and len(set(wide[e, t].values())) >= 3 and len(far[e]) >= 3:
                mutual = np.log2(len(both) * len(texts) / (len(e_in[e]) * len(t_in[t])))
                if np.log2(len(texts) / len(e_in[e])) - mutual <= 0.5 + 1e-9:
                    terms.add(t)
    assert 0 < len(terms & set(rare)) < len(rare)
    want = {i: ",".join(f"{k}:{a}:{b}" for a, k, b in sorted((m.start(), "email" if "@" in m[0] else "term", m.end()) for m in re.finditer(r"\S+", t) if "@" in m[0] or m[0] in terms)) for i, t in rows}
    assert {r.doc_id: r.spans for r in pii.find(docs(spark, rows)).collect()} == want


def test_pii_edges(spark):
    rows = [*awkward(), (50, "call +1 (202) 555-0123 or 4111 1111 1111 1111 8, ip 1.2.3.4.5")]
    got = pii.find(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    for i, t in [(50, rows[-1][1])]:
        r = next(x for x in got if x.doc_id == i)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_by_hand(t)).encode()).hexdigest()
    assert pii.find(docs(spark, [])).count() == 0
    same = pii.sanitise(docs(spark, awkward(), extra=True))
    assert same.columns == docs(spark, [], extra=True).columns
    assert sorted(str(r.text) for r in same.collect()) == sorted(str(t) for _, t in awkward())


# -- 10
def contaminated(rows, items, n=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            grams.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[tuple(w[k : k + size])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((str(d), len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2))
    return sorted(out)


ITEMS = [(1, "Alpha beta gamma delta éa ß 日本 x1 tail"), (2, "one"), (3, None), (4, "!!"), (10, "a-b c_d, e f g h"), (None, "x"), (2, "alpha Beta gamma, delta. éa ß 日本 x1")]


@pytest.mark.parametrize("set_bytes", [1 << 20, 40])
def test_decontamination(spark, set_bytes):
    rows = [*awkward(), (60, "see: ALPHA, beta; gamma delta éa ß 日本 x1 tail end"), (61, "two one A B c d e F g h one")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.report(docs(spark, rows, extra=True), items, set_bytes=set_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == contaminated(rows, ITEMS)


def test_clean(spark):
    rows = [(60, "see: ALPHA, beta; gamma delta éa ß 日本 x1 tail. end"), (61, "one a b c d e f g h"), (62, None), (63, "fine")]
    df = docs(spark, rows, extra=True)
    got = decontaminate.clean(df, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {62: None, 63: "fine"}
    one = decontaminate.clean(df, spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert {r.doc_id: r.text for r in one.collect()}[60] == "see: . end"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(df, none).where("n_hit > 0").count() == 0
    assert decontaminate.report(docs(spark, []), none).count() == 0


def test_schema_helper(spark):
    assert docs(spark, []).schema == spark.createDataFrame([], DOCS).schema
