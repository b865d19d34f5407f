"""Operator 3: repeated passages, by a count-min prefilter and an exact second pass.

A window is 20 consecutive words. Its anchor is the leftmost of its 8-word runs with the smallest hash: a function of
the window's words alone, so two occurrences of a window have anchors at two places with one value. The sketch counts
anchor values by place; a window is dropped before the shuffle only if its anchor's estimate is below two, and as
estimates never fall short, no repeated window is lost. Anchors are about a seventh of all windows.

Pass 1: each task's sketch goes out as sparse cells by block (a cell at most twice), blocks are added up, and all that is
kept of a cell is one bit, for two or more. Pass 2: windows that may repeat are grouped exactly by 128-bit hashes of
their words, each task sending the first place of a window only; the group gives back the first place of all. A window
that may repeat and isn't the first of its group is a copy (one that doesn't repeat is its own first).

The sketch has SKETCH_LOAD bytes of text a cell, up to MAX_CELLS cells; beyond that many, estimates grow and more
windows pass to the exact grouping, with the same result.

Places are ordered by doc_id, then start. Rows with one id are ordered by their text's hash; equal rows are one place,
so they keep the same words. A null id comes before all others. A null text has no words and gives the digest of the
empty text. An empty table gives no rows. Other columns pass through `deduplicate` only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mix, runs_to_mask, stored, texts_of, windows

WINDOW, ANCHOR = 20, 8
ROWS, BLOCK_BITS = 2, 18
SKETCH_LOAD, MAX_CELLS = 10, 1 << 28
FLUSH = 1 << 21
_NULL_ID = -(1 << 63)

_U = np.uint64


def _anchors(hashes: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, the places of their anchors, and the hash at each word's place."""
    n = len(hashes)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    grams = windows(hashes, anchor, 11)
    size = window - anchor + 1  # runs in a window
    # The low 28 bits are the place, so that the smallest is the leftmost of equal leading bits: the choice depends on
    # the words only. A single text has fewer than 2^28 words, as Arrow's and Spark's strings end at 2 GB.
    best = ((grams >> _U(28)) << _U(28)) | np.arange(len(grams), dtype=_U)
    width = 1
    while width * 2 <= size:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    if width < size:
        best = np.minimum(best[: len(best) - (size - width)], best[size - width :])
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    return starts, (best[starts] & _U((1 << 28) - 1)).astype(np.int64), grams


def _cells(keys: np.ndarray, cell_bits: int) -> list[np.ndarray]:
    return [(mix(keys, 100 + r) >> _U(64 - cell_bits)).astype(np.int64) for r in range(ROWS)]


def _sketch(texts: DataFrame, cell_bits: int, window: int, anchor: int) -> DataFrame:
    """(r, block, bits): one bit for each cell that counts two or more."""
    block_bits = min(BLOCK_BITS, cell_bits)

    def partial(keys: list[np.ndarray]):
        for r, cells in enumerate(_cells(np.concatenate(keys), cell_bits)):
            cells, counts = np.unique(cells, return_counts=True)
            cells = np.sort(np.concatenate((cells, cells[counts > 1])))
            blocks = cells >> block_bits
            cuts = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1)) if len(cells) else np.zeros(1, np.int64)
            low = (cells & ((1 << block_bits) - 1)).astype("<u4")
            parts = [low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), r, np.int32)), pa.array(blocks[cuts[:-1]].astype(np.int64)), pa.array(parts, pa.binary())], ["r", "block", "cells"])

    def tasks(batches):
        held, total = [], 0
        for batch in batches:
            texts = texts_of(batch, "text")
            for low, high in cut(texts):
                w = Words(texts[low:high])
                _, places, grams = _anchors(w.hashes(), w.doc(), window, anchor)
                if len(places):
                    held.append(grams[np.unique(places)])
                    total += len(held[-1])
                if total > FLUSH:
                    yield from partial(held)
                    held, total = [], 0
        if held:
            yield from partial(held)

    def merge(tab: pa.Table) -> pa.Table:
        counts = np.zeros(1 << block_bits, np.int32)
        for part in tab.column("cells").to_pylist():
            counts += np.bincount(np.frombuffer(part, "<u4"), minlength=1 << block_bits).astype(np.int32)
        bits = np.packbits(counts >= 2).tobytes()
        return pa.table({"r": tab.column("r")[:1], "block": tab.column("block")[:1], "bits": pa.array([bits], pa.binary())})

    return stored(texts.mapInArrow(tasks, "r int, block long, cells binary").groupBy("r", "block").applyInArrow(merge, "r int, block long, bits binary"))


class _Filter:
    """The merged sketch, as one bit a cell; MAX_CELLS bounds it at 32 MB a row."""

    def __init__(self, cell_bits: int, blocks: list):
        self.cell_bits, self.bits = cell_bits, np.zeros((ROWS, (1 << cell_bits) // 8), np.uint8)
        step = (1 << min(BLOCK_BITS, cell_bits)) // 8
        for r, block, bits in blocks:
            self.bits[r, block * step : (block + 1) * step] = np.frombuffer(bits, np.uint8)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for r, cells in enumerate(_cells(keys, self.cell_bits)):
            out &= (self.bits[r][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
        return out


def _candidates(w: Words, sketch: _Filter, window: int, anchor: int):
    """Starts (word numbers) of windows that may repeat, with the words' hashes."""
    hashes = w.hashes()
    starts, places, grams = _anchors(hashes, w.doc(), window, anchor)
    if len(starts):
        kinds, back = np.unique(places, return_inverse=True)
        starts = starts[sketch.repeated(grams[kinds])[back]]
    return starts, hashes


def _first_places(texts: DataFrame, held, window: int, anchor: int) -> DataFrame:
    """(h1, h2, d, k, s): in each task, the first place of each window that may repeat."""

    def one(h1, h2, d, k, s):
        order = np.lexsort((s, k, d, h2, h1))
        h1, h2, d, k, s = (x[order] for x in (h1, h2, d, k, s))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return tuple(x[new] for x in (h1, h2, d, k, s))

    def batch_of(held):
        cols = one(*(np.concatenate(x) for x in zip(*held)))
        for i in range(0, len(cols[0]), 200_000):
            h1, h2, d, k, s = (x[i : i + 200_000] for x in cols)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(d), pa.array(k), pa.array(s.astype(np.int32))], ["h1", "h2", "d", "k", "s"])

    def tasks(batches):
        sketch = _Filter(*held.value)
        kept, total = [], 0
        for batch in batches:
            texts, ids, keys = texts_of(batch, "text"), batch.column("d").to_numpy(), batch.column("k").to_numpy()
            for low, high in cut(texts):
                w = Words(texts[low:high])
                starts, hashes = _candidates(w, sketch, window, anchor)
                if not len(starts):
                    continue
                doc = np.searchsorted(w.first, starts, "right") - 1
                kept.append((windows(hashes, window, 1)[starts], windows(hashes, window, 2)[starts], ids[low + doc], keys[low + doc], starts - w.first[doc]))
                total += len(starts)
                if total > FLUSH:
                    yield from batch_of(kept)
                    kept, total = [], 0
        if kept:
            yield from batch_of(kept)

    return texts.mapInArrow(tasks, "h1 long, h2 long, d long, k long, s int")


def _marked(docs: DataFrame, window: int, anchor: int, types: str, finish) -> DataFrame:
    """Applies finish(batch, low, texts, words, copies) where copies flags the words that go."""
    spark = docs.sparkSession
    id_and_key = [F.coalesce(F.col("_id"), F.lit(_NULL_ID)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")]
    texts = docs.select("text", *id_and_key)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cell_bits = max(16, min(MAX_CELLS, max(1, int(total) // SKETCH_LOAD)).bit_length())
    cell_bits = min(cell_bits, MAX_CELLS.bit_length() - 1)
    # At most ROWS * MAX_CELLS bits, 64 MB, whatever the size of the input.
    held = spark.sparkContext.broadcast((cell_bits, [(x.r, x.block, bytes(x.bits)) for x in _sketch(texts, cell_bits, window, anchor).toLocalIterator()]))
    places = _first_places(texts, held, window, anchor)
    firsts = places.groupBy("h1", "h2").agg(F.min(F.struct("d", "k", "s")).alias("p")).groupBy(F.col("p.d").alias("_d"), F.col("p.k").alias("_k")).agg(F.collect_list("p.s").alias("_firsts"))
    joined = docs.select("*", *id_and_key).join(firsts, F.expr("d = _d AND k = _k"), "left").select(*docs.columns, "_firsts")

    def tasks(batches):
        sketch = _Filter(*held.value)
        for batch in batches:
            texts, firsts = texts_of(batch, "text"), batch.column("_firsts")
            for low, high in cut(texts):
                w = Words(texts[low:high])
                starts, _ = _candidates(w, sketch, window, anchor)
                candidate = np.zeros(len(w.starts), bool)
                candidate[starts] = True
                part = firsts.slice(low, high - low)
                lists = [(k, x.values.to_numpy()) for k, x in enumerate(part) if x.is_valid]
                for k, own in lists:
                    candidate[w.first[k] + own] = False
                copies = runs_to_mask(np.flatnonzero(candidate), window, len(w.starts))
                yield finish(batch.slice(low, high - low), texts[low:high], w, copies)

    return joined.mapInArrow(tasks, types)


def report(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""

    def finish(batch, texts, w, copies):
        rows = []
        for k in range(len(texts)):
            a, b = w.first[k], w.first[k + 1]
            gone = copies[a:b]
            words = texts[k].split()
            kept = [x for x, c in zip(words, gone.tolist()) if not c] if gone.any() else words
            rows.append((int(b - a), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, m, h = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(h)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    return _marked(docs, window, anchor, "doc_id long, n_words long, n_removed long, kept_sha256 string", finish)


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs with copied passages cut out of the texts; texts without any stay as they are."""
    names = docs.columns

    def finish(batch, texts, w, copies):
        new = []
        for k in range(len(texts)):
            a, b = w.first[k], w.first[k + 1]
            kept = None
            if copies[a:b].any():
                runs = np.flatnonzero(np.diff(np.concatenate(([0], copies[a:b].view(np.int8), [0]))))
                out, at = [], 0
                for x, y in zip(runs[0::2], runs[1::2]):
                    out.append(texts[k][at : w.starts[a + x] - w.offsets[k]])
                    at = w.ends[a + y - 1] - w.offsets[k]
                kept = b"".join([*out, texts[k][at:]]).decode()
            new.append(kept)
        return pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(new, pa.string())], ["_row", "_new"])

    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    out = _marked(held, window, anchor, f"_row {docs.schema.simpleString()}, _new string", finish)
    return out.select(*[F.coalesce("_new", F.col(f"_row.`{n}`")).alias(n) if n == text_col else F.col(f"_row.`{n}`").alias(n) for n in names])
