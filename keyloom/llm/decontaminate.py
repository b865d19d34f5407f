"""Operator 10: benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. An item's windows are its runs
of 8 words; an item with fewer words is one window, an item without words has none. Workers roll a 64-bit hash over each
text, look it up in the set, and verify each hit on the words themselves. A word inside any occurrence is hit.

The set is broadcast for benchmarks of up to SET_BYTES of text. A larger benchmark is split by item into sets of that
size, and the documents pass one set after another, with the result so far stored in between.

Nulls: a null text has no words; a null item id still marks words but is no item. Items with one id count once. Empty
tables: no rows, or rows without hits. Repeated documents are judged alike. Other columns pass through `clean` only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, stored, texts_of, windows

WINDOW = 8
SET_BYTES = 16 << 20

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_STATE = "hit binary, n_words long, items array<string>"


def _item_windows(rows: list[tuple[str | None, bytes]], window: int) -> dict[int, dict[bytes, set]]:
    """By length: the windows as words joined by a blank, with their items."""
    out: dict[int, dict[bytes, set]] = {}
    for item, text in rows:
        w = Words([text], WORD, lower=True)
        words = [w.data[a:b] for a, b in zip(w.starts, w.ends)]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            out.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), set()).add(item)
    return out


def _hashed(found: dict[int, dict[bytes, set]]) -> dict[int, tuple[np.ndarray, np.ndarray, dict]]:
    """By length: a table of 2^20 flags on the low bits, the sorted hashes, the windows."""
    out = {}
    for size, grams in found.items():
        w = Words(list(grams), WORD)
        values = np.unique(windows(w.hashes(), size, size)[w.first[:-1]])
        flags = np.zeros(1 << 20, bool)
        flags[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        out[size] = (flags, values, grams)
    return out


def _scan(texts: list[bytes], sets) -> list[tuple[np.ndarray, set]]:
    """For each text, a flag for each word and the items found."""
    w = Words(texts, WORD, lower=True)
    hit, items, doc = np.zeros(len(w.starts), bool), [set() for _ in texts], w.doc()
    hashes = w.hashes()
    for size, (flags, values, grams) in sets.items():
        rolled = windows(hashes, size, size)
        at = np.flatnonzero(flags[(rolled & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[doc[at] == doc[at + size - 1]]
        if len(values):
            at = at[values[np.minimum(np.searchsorted(values, rolled[at]), len(values) - 1)] == rolled[at]]
        for i in at.tolist():
            gram = grams.get(b" ".join([w.data[a:b] for a, b in zip(w.starts[i : i + size].tolist(), w.ends[i : i + size].tolist())]))
            if gram is not None:
                hit[i : i + size] = True
                items[doc[i]] |= gram
    return [(hit[w.first[k] : w.first[k + 1]], items[k]) for k in range(len(texts))]


def _benchmark_sets(benchmark: DataFrame, window: int, set_bytes: int) -> list[dict]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    parts = -(-total // set_bytes) or 1
    part = F.pmod(F.xxhash64("t"), F.lit(parts))  # each part is bounded by set_bytes, and so is what the driver holds at once
    for k in range(parts):
        yield _item_windows([(r.i, r.t.encode()) for r in rows.where(part == k).toLocalIterator()], window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_bytes: int = SET_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and _text, hit (bits, one a word), n_words, items (sorted strings)."""
    spark = docs.sparkSession
    out = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.lit(None).cast("binary").alias("hit"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<string>)").alias("items"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    for k, found in enumerate(_benchmark_sets(benchmark, window, set_bytes)):
        sets = spark.sparkContext.broadcast(found)

        def run(batches, sets=sets):
            ready = _hashed(sets.value)
            for batch in batches:
                texts = texts_of(batch, "_text")
                for low, high in cut(texts):
                    part = batch.slice(low, high - low)
                    hits, counts, items = [], [], []
                    for (flags, found), old, own in zip(_scan(texts[low:high], ready), part.column("hit").to_pylist(), part.column("items").to_pylist()):
                        if old:
                            flags = flags | np.unpackbits(np.frombuffer(old, np.uint8), count=len(flags)).astype(bool)
                        hits.append(np.packbits(flags).tobytes())
                        counts.append(len(flags))
                        items.append(sorted({*own, *(x for x in found if x is not None)}))
                    names = part.schema.names
                    columns = [part.column(n) for n in names[:-3]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.binary()), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string()))], names)

        out = (stored(out) if k else out).mapInArrow(run, f"{types}{', ' if types else ''}_text string, {_STATE}")
    return out


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **options) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs, benchmark, **options)
    return found.select("doc_id", "n_words", _ones(F.col("hit")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"))


def _ones(bits):
    """Set bits of a binary, counted on its hex digits."""
    text = F.hex(bits)
    count = F.lit(0)
    for digit in range(1, 16):
        count = count + F.lit(digit.bit_count()) * (F.length(text) - F.length(F.translate(text, f"{digit:X}", "")))
    return count.cast("long")


def _without(text: bytes, flags: np.ndarray) -> bytes:
    """The text without its hit spans; what stands between two hit words goes too."""
    if not flags.any():
        return text
    w = Words([text], WORD, lower=True)
    runs = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(runs[0::2], runs[1::2]):
        out.append(text[at : w.starts[a]])
        at = w.ends[b - 1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **options) -> DataFrame:
    """The columns of docs: documents with min_items or more test items are dropped, hit spans of the others are cut out.

    A document without hits keeps its text as it is, null included."""
    names, schema = docs.columns, docs.schema
    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col("text"))
    found = scan(held, benchmark, keep=("_row",), **options).where(F.size("items") < min_items)

    def run(batch):
        texts = texts_of(batch, "_text")
        out = []
        for text, hit, n in zip(texts, batch.column("hit").to_pylist(), batch.column("n_words").to_pylist()):
            flags = np.unpackbits(np.frombuffer(hit, np.uint8), count=n).astype(bool)
            out.append(_without(text, flags).decode() if flags.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], ["_row", "_new"])

    def each(batches):
        for batch in batches:
            yield from run(batch)

    out = found.mapInArrow(each, f"_row {schema.simpleString()}, _new string")
    return out.select(*[F.coalesce("_new", F.col("_row.text")).alias(n) if n == "text" else F.col(f"_row.`{n}`").alias(n) for n in names])
