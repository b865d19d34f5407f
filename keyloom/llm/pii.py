"""Operator 9: personal data, and terms that disclose it.

Base spans (code points) are e-mail addresses, IPv4 addresses, card and phone numbers. The method adds spans of kind
`term`: for a base value e and a word t of the same documents, the pointwise mutual information
log2(p(e,t) / (p(e) p(t))) is compared with the value's information content log2(1 / p(e)). What is left between the two,
log2(1 / p(e|t)), is what stays unknown of the value to one who sees the word. With DISCLOSE bits or fewer the word gives
the value away and is generalised; with REMOVE bits or fewer it is removed: wherever it stands, in all documents, except
inside base spans. Bits left do not depend on the size of the corpus, so thresholds mean the same at every size.

p(t), p(e) and p(e,t) count distinct texts of the whole corpus. Evidence is counted apart: a pair needs MIN_CONTEXTS
documents that differ in the REACH words at each side of the value, and as many that differ in those around
the word, so copies of one passage are one piece of it.

Patterns run in linear time on texts of any length. What workers are told of values, words and copies are bitmaps of
bounded size; they pass all that is wanted and a little more, which joins take out. Texts of documents without findings
of words stay where they are at every size.

Nulls: a null text is empty, a null id is kept. Repeated rows give equal rows. An empty table gives no rows. Columns of
any name pass through `sanitise`; `find` reads the id and the text only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, flagged, letter_words, packed, stored, unpacked, word_hash

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSE, REMOVE, MIN_CONTEXTS, REACH = 0.5, 0.1, 3, 10
#: (value, word) pairs or words that a task tallies before it sends them, and texts or words it remembers.
TALLIES, SEEN = 100_000, 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can't begin inside a run of digits where none begins at its start, so later digits are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += _DOUBLED[int(d)] if k % 2 else int(d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """An address is found from its @, back over the local part to the last match at most."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1) if at > free else None
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _value(text: str, span: tuple[int, int, str]) -> str:
    a, kind, b = span
    return f"{KINDS[kind]}:{text[a:b].lower() if kind < 2 else _digits(text[a:b])}"


def _digest(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _words(text: str, spans: list) -> list[tuple[int, int, str]]:
    """(start, end, word) outside of base spans."""
    out, k, past = [], 0, 0
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            past = max(past, spans[k][2])
            k += 1
        if past <= m.start():
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def _contexts(text: str, spans: list) -> dict[str, int]:
    """The values of a text, each with a digest of the words near all its places."""
    if not spans:
        return {}
    words, near = _words(text, spans), {}
    starts = [w[0] for w in words]
    for span in spans:
        k = bisect_right(starts, span[0])
        near.setdefault(_value(text, span), []).extend(["|", *(w[2] for w in words[max(0, k - REACH) : k + REACH])])
    return {e: _digest(w) for e, w in near.items()}


_SCAN = "doc_id long, key long, base string, n_email long, n_ip long, n_card long, n_phone long, near array<struct<e: string, c: long>>"
_TERMS = "array<struct<s: int, z: int, bits: double>>"


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches):
    for batch in batches:
        cols = [[] for _ in range(6)]
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            cols[0].append(_joined(spans))
            for k in range(4):
                cols[k + 1].append(sum(x[1] == k for x in spans))
            cols[5].append([{"e": e, "c": c} for e, c in _contexts(text, spans).items()])
        near = pa.array(cols[5], pa.list_(pa.struct([("e", pa.string()), ("c", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:5]], near], ["doc_id", "key", "base", "n_email", "n_ip", "n_card", "n_phone", "near"])


def _bits(values: DataFrame):
    """A broadcast bitmap of the column h."""
    return values.sparkSession.sparkContext.broadcast(Bits(values))


def _hashed(terms: DataFrame) -> DataFrame:
    """Adds h, the hash by which workers find a word."""

    def run(batches):
        for batch in batches:
            found = [word_hash(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64))], [*batch.schema.names, "h"])

    return stored(terms.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in terms.dtypes) + ", h long"))


def _once(seen: set, key: int) -> bool:
    if key in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(key)
    return True


def _document_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, n): distinct texts of the corpus that hold each term, and maybe some other words.

    Texts that have copies are sent by key, so that each counts once; all others are counted in each task first."""
    held = _bits(terms)

    def run(batches):
        known, counts, seen = held.value, [], set()

        def sent(key, n, words):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["key", "n", "words"])

        def tallied():
            h, at = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in counts])).astype(np.int64)
            for k in range(0, len(h), TALLIES):
                part = h[k : k + TALLIES].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32)), pa.array(part))
                yield sent([None] * len(part), n[k : k + TALLIES], lists)

        for batch in batches:
            copied = batch.column("_maybe").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_pylist()
            fresh = np.array([not c or _once(seen, k) for k, c in zip(keys, copied.tolist())], bool)
            own, lists = [], []
            for low, hashes, doc, _, _ in letter_words(batch.column("text").to_pylist()):
                at = np.flatnonzero(known.has(hashes))
                at = at[fresh[low + doc[at]]]
                order = np.lexsort((hashes[at], doc[at]))
                doc, hashes = doc[at][order], hashes[at][order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                doc, hashes = doc[new], hashes[new]
                single = ~copied[low + doc]
                counts.append(np.unique(hashes[single], return_counts=True))
                doc, hashes = doc[~single], hashes[~single]
                for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else ():
                    own.append(keys[low + doc[part[0]]])
                    lists.append(hashes[part].view(np.int64))
            yield sent(own, [1] * len(own), lists)
            if sum(len(x) for x, _ in counts) > 20 * TALLIES:
                yield from tallied()
                counts.clear()
        if counts:
            yield from tallied()

    found = texts.mapInArrow(run, "key long, n long, words array<long>")
    each = found.groupBy("key", F.expr("if(key IS NULL, words[0], NULL)").alias("h")).agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    return each.select(F.explode("words").alias("h"), F.expr("if(key IS NULL, n, 1)").alias("n")).groupBy("h").agg(F.sum("n").cast("double").alias("n"))


def _pairs(texts: DataFrame, values: DataFrame, min_contexts: int) -> DataFrame:
    """(e, t, n_et): values and words of the same documents that have the evidence; n_et counts distinct texts."""
    held = _bits(values.select(F.xxhash64("e").alias("h")))

    def run(batches):
        bits, tally, seen = held.value, {}, set()

        def known(e):
            return bits.has(np.array([xxhash.xxh64_intdigest(e.encode("utf-8", "surrogatepass"), 42)], np.uint64))[0]  # as SQL's xxhash64

        def sent():
            rows = [(None, e, t, n if i == 0 else 0, c, d) for (e, t), (n, places) in tally.items() for i, (c, d) in enumerate(places)]
            tally.clear()
            return batch_of(rows)

        def batch_of(rows):
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "e", "t", "n", "c", "d"])

        for batch in batches:
            copies = []
            for text, key, copied in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), batch.column("_maybe").to_pylist()):
                spans = base_spans(text)
                near = {e: c for e, c in _contexts(text, spans).items() if known(e)} if spans else {}
                if not near or copied and not _once(seen, key):
                    continue
                words, around = _words(text, spans), {}
                for k, (_, _, t) in enumerate(words):
                    if t not in around:
                        around[t] = _digest([w[2] for w in words[max(0, k - REACH) : k + REACH + 1]])
                for e, c in near.items():
                    for t, d in around.items():
                        if copied:
                            copies.append((key, e, t, 1, c, d))
                            continue
                        x = tally.setdefault((e, t), [0, []])
                        x[0] += 1
                        # A place is kept while it may add evidence of either kind.
                        if len({p[0] for p in x[1]} | {c}) > len({p[0] for p in x[1]}) <= min_contexts or len({p[1] for p in x[1]} | {d}) > len({p[1] for p in x[1]}) <= min_contexts:
                            x[1].append((c, d))
                    if len(tally) > TALLIES:
                        yield sent()
            yield batch_of(copies)
        yield sent()

    found = texts.mapInArrow(run, "key long, e string, t string, n long, c long, d long")
    once = found.groupBy("key", "e", "t", "c", "d").agg(F.sum("n").alias("s"), F.max("n").alias("m")).select("e", "t", "c", "d", F.expr("if(key IS NULL, s, m)").alias("n"))
    pairs = once.groupBy("e", "t").agg(F.sum("n").cast("double").alias("n_et"), F.countDistinct("c").alias("far"), F.countDistinct("d").alias("wide"))
    return pairs.where((F.col("far") >= min_contexts) & (F.col("wide") >= min_contexts)).join(values.select("e"), "e", "left_semi").select("e", "t", "n_et")


def disclosures(scanned: DataFrame, texts: DataFrame, disclose: float = DISCLOSE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(e, t, bits): words that leave `disclose` bits or fewer of a value unknown. texts: (text, key)."""
    near = scanned.select("key", F.explode("near").alias("x")).select("key", "x.e", "x.c")
    values = near.groupBy("e").agg(F.countDistinct("key").cast("double").alias("n_e"), F.countDistinct("c").alias("far"))
    values = stored(values.where(F.col("far") >= min_contexts).select("e", "n_e"))
    copies = stored(scanned.groupBy(F.col("key").alias("h")).count().where("count > 1").select("h"))
    texts = flagged(texts.select("text", "key"), "key", copies)
    pairs = stored(_pairs(texts, values, min_contexts))
    total = scanned.select("key").distinct().count()
    terms = _hashed(pairs.select("t").distinct())
    counts = terms.join(_document_counts(texts, terms), "h").select("t", "n")
    n = F.lit(float(max(total, 1)))
    rows = pairs.join(values, "e").join(counts, "t").withColumn("n_t", F.greatest("n", "n_et"))
    mutual, content = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t"))), F.log2(n / F.col("n_e"))
    return rows.select("e", "t", F.greatest(content - mutual, F.lit(0.0)).alias("bits")).where(F.col("bits") <= disclose + 1e-9)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key (the text's hash) and h (that of both)."""
    number, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(number.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"), F.xxhash64(number, F.xxhash64(text), number.isNull()).alias("h"))


def _shares(scanned: DataFrame, texts: DataFrame, options: dict) -> DataFrame:
    """(t, bits): disclosing words, each with the fewest bits it leaves of a value."""
    return stored(disclosures(scanned, texts, **options).groupBy("t").agg(F.min("bits").alias("bits")))


def _term_places(texts: DataFrame, given: DataFrame) -> DataFrame:
    """(h, terms): the places of disclosing words for the documents that hold any, stored."""
    held = _bits(_hashed(given))

    def run(batches):
        for batch in batches:
            rows, texts, ids = [], batch.column("text").to_pylist(), batch.column("h").to_pylist()
            for low, hashes, doc, starts, ends in letter_words(texts):
                at = np.flatnonzero(held.value.has(hashes))
                for d in np.unique(doc[at]).tolist():
                    text, own = texts[low + d], at[doc[at] == d]
                    free = {(s, z) for s, z, _ in _words(text, base_spans(text))}
                    rows += [(ids[low + d], text[s:z].lower(), s, z) for s, z in zip(starts[own].tolist(), ends[own].tolist()) if (s, z) in free]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["h", "t", "s", "z"])

    found = texts.select("text", "h").mapInArrow(run, "h long, t string, s int, z int").join(given, "t")
    return stored(found.groupBy("h").agg(F.sort_array(F.collect_set(F.struct("s", "z", "bits"))).alias("terms")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    texts = _texts(docs, id_col, text_col)
    scanned = stored(texts.select("doc_id", "text", "key").mapInArrow(_scan, _SCAN))
    terms = _term_places(texts, _shares(scanned, texts, options))
    rows = scanned.drop("near").withColumn("h", F.expr("xxhash64(doc_id, key, doc_id IS NULL)")).join(terms, "h", "left")
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    terms = F.transform(F.coalesce("terms", F.expr(f"cast(array() AS {_TERMS})")), lambda t: F.concat(F.lit("term:"), t["s"].cast("string"), F.lit(":"), t["z"].cast("string")))
    # structs compare by start, then by the kind's rank
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split(x, ":")[0])
    spans = F.transform(F.array_sort(F.transform(F.concat(base, terms), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), rank(x).alias("r"), x.alias("x")))), lambda y: y["x"])
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"))


def _rewrite(text: str, base: list, terms: list, remove: float = REMOVE) -> str:
    """Base values become <KIND>; terms are removed, or generalised to <TERM>."""
    cuts = [(a, b, f"<{KINDS[k].upper()}>") for a, k, b in base]
    cuts += [(t["s"], t["z"], "" if t["bits"] <= remove else "<TERM>") for t in terms or ()]
    out, at = [], 0
    for a, b, new in sorted(cuts):
        if a < at:  # overlaps the one before: what is left of it goes as well
            at = max(at, b)
            continue
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """The columns of docs with their texts rewritten; a text without findings stays as it is, null included.

    Base values are found where the texts are. Texts that may hold disclosing words (a bitmap of bounded size says which)
    are joined with the words' places; no others travel."""
    names, texts = docs.columns, _texts(docs, id_col, text_col)
    scanned = stored(texts.select("doc_id", "text", "key").mapInArrow(_scan, _SCAN))
    places = _term_places(texts, _shares(scanned, texts, options))

    def run(batches):
        for batch in batches:
            new = []
            for text, terms in zip(batch.column("_text").to_pylist(), batch.column("terms").to_pylist()):
                base = base_spans(text) if text else []
                new.append(_rewrite(text, base, terms, remove) if base or terms else None)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(new, pa.string())], ["_row", "_new"])

    number, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    held = packed(docs, _text=text, h=F.xxhash64(number, F.xxhash64(F.coalesce(text, F.lit(""))), number.isNull()))
    marked = flagged(held, "h", places.select("h"))
    still = marked.where("NOT _maybe").select("_row", "_text", F.lit(None).cast(_TERMS).alias("terms"))
    moved = marked.where("_maybe").join(places, "h", "left").select("_row", "_text", "terms")
    out = still.unionByName(moved).mapInArrow(run, f"_row {docs.schema.simpleString()}, _new string")
    out = out.select(F.col("_row").withField(f"`{text_col}`", F.coalesce("_new", F.col(f"_row.`{text_col}`").cast("string"))).alias("_row"))
    return unpacked(out, names)
