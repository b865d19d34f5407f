"""Operator 6: best-fit packing with a swap-based local search.

Documents are tokenised and ended by id 0; only those longer than a sequence are cut. All that packing needs of the
pieces is how many there are of each length, at most `size` counts whatever the corpus. The driver packs these counts:
a bin type is a multiset of lengths with the number of bins that are alike. Best fit within parts is followed by a
local search over all underfull bins: moving a piece, exchanging one for one, two for one or one for two, always so that
the fuller bin gains (the sum of squared fills grows) until bins are empty and go, or no exchange is left. The pieces are then numbered within their length, in two levels so that a length with a third of all pieces is no single
group, and each number has its place in a bin type.

Nulls: a null text is empty and gives the one token 0; a null id is kept. Repeated rows are packed each on its own.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import logging
import os
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SIZE, END, PARTS = 2048, 0, 8
log = logging.getLogger(__name__)
#: Chunks of text whose ids a worker remembers.
CACHE = 120_000

# Where one of these stands, a text isn't cut at white space, as the pre-tokeniser may see a blank there differently.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85]")
_PUNCTUATION = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~\""  # runs of these are one piece; an apostrophe can begin another
_END_OF_WORD = b"\xff"  # no byte of UTF-8


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def ranked_vocabulary(path: str) -> dict[bytes, int] | None:
    """Tokens as bytes by rank, if greedy merging by rank gives what the file's merge list gives, else None.

    Let all tokens of a vocabulary be reached when they stand alone, each by one pair. Inside a token's bounds, merging
    goes on as if it stood alone for as long as nothing merges across them; so two neighbours that together make a token
    are the very pair that its merge names, and merging by the rank of the result is merging by the list. Ends of words
    are a byte of their own, which joins its neighbour before anything else does."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    rank = {pair: k for k, pair in enumerate(merges)}
    first = len(vocab) - len(merges) - sum(t.startswith("<|") for t in vocab)
    if model.get("end_of_word_suffix") != "</w>" or len({a + b for a, b in merges}) != len(merges) or any(vocab.get(a + b) != first + k for k, (a, b) in enumerate(merges)):
        return None
    out = {}
    for token, number in vocab.items():
        if token.startswith("<|"):
            continue
        body, end = (token[:-4], True) if token.endswith("</w>") else (token, False)
        parts = list(body)
        if not parts or any(c not in letters for c in parts):
            return None
        if end:
            parts[-1] += "</w>"
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[k], parts[k + 1]) not in rank:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        out[bytes(letters[c] for c in body) + _END_OF_WORD * end] = number
    return out if sorted(out.values())[: len(out)] == list(range(len(out))) else None


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The pre-tokeniser drops white space and never joins what it parts, so a text's ids are those of its chunks between
    white space, and chunks recur. A chunk of letters, with marks after them at most, is merged by rank (see
    ranked_vocabulary); all others go through the tokenizer. What a worker remembers is bounded; it changes speed only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.known, self.merge = Tokenizer.from_file(path), {}, None
        ranks = ranked_vocabulary(path)
        if ranks:
            import tiktoken

            core = tiktoken.Encoding("words", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={})
            self.merge = getattr(core, "_encode_single_piece", None)
        self.marks = {"": b""}

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for k in range(0, len(texts), 1000) for e in self.tok.encode_batch_fast(texts[k : k + 1000], add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        rest, known, merge, marks = [], self.known, self.merge, self.marks
        if len(marks) > 10_000:
            marks.clear()
        for word in words:
            stem = word.rstrip(_PUNCTUATION)
            tail = word[len(stem) :]
            if tail not in marks:
                marks[tail] = self._slow([tail])[0]
            # Composed letters only; a capital sigma's small letter depends on its place in str.lower().
            if merge and stem.isalpha() and (stem.isascii() or "\u03a3" not in stem and unicodedata.is_normalized("NFC", stem) and stem.lower().isalpha()):
                ids = merge(stem.lower().encode() + _END_OF_WORD)
                known[word] = struct.pack(f"<{len(ids)}I", *ids) + marks[tail]
            else:
                rest.append(word)
        self.known.update(zip(rest, self._slow(rest)))

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._slow([text])[0]
        words, known = text.split(), self.known
        new = {w for w in words if w not in known}
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(words)
            self._learn(list(new))
        return b"".join(map(known.__getitem__, words))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and key (its text's hash); with_ids: also the ids."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(text_col).alias("key"))
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, rows = batch.slice(k, 256), []
                for d, key, text in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text) + last
                    for n, at in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[at : at + 4 * size]
                        rows.append((d, n, at // 4, len(piece) // 4, zlib.crc32(piece), key, piece if with_ids else None))
                d, n, at, length, crc, key, parts = zip(*rows)
                cols = [pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(key, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "key"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, key long" + (", ids array<int>" if with_ids else ""))


def _sorted(kind: dict[int, int]) -> tuple:
    return tuple(sorted(((a, n) for a, n in kind.items() if n), reverse=True))


def parts_of(counts: dict[int, int], parts: int = PARTS, seed: int = 1) -> list[dict[int, int]]:
    """The counts dealt to parts that are packed on their own, each length's odd pieces from a seeded part on."""
    out: list[dict[int, int]] = [{} for _ in range(parts)]
    first = np.random.Generator(np.random.PCG64(seed)).integers(0, parts, len(counts))
    for (a, n), at in zip(sorted(counts.items()), first.tolist()):
        for k in range(min(n, parts)):
            out[(at + k) % parts][a] = (n + parts - 1 - k) // parts
    return out


def best_fit(counts: dict[int, int], size: int) -> Counter:
    """Best fit, longest first, on counts: a Counter of bin types, each a tuple of (length, pieces) by falling length."""
    open_at: dict[int, Counter] = {}  # by room: bin types and how many
    rooms: list[int] = []  # sorted rooms that have bins
    full: Counter = Counter()

    def put(room: int, kind: tuple, n: int) -> None:
        if room == 0:
            full[kind] += n
            return
        if room not in open_at:
            open_at[room] = Counter()
            insort(rooms, room)
        open_at[room][kind] += n

    for length, left in sorted(counts.items(), reverse=True):
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = size // length
                n, rest = divmod(left, each)
                if n:
                    put(size - each * length, ((length, each),), n)
                if rest:
                    put(size - rest * length, ((length, rest),), 1)
                break
            room = rooms[i]
            kind, n = next(iter(open_at[room].items()))
            each = room // length  # best fit goes on with the bin it has just filled, whose room is now the least
            if left >= each:
                n = min(n, left // each)
            else:
                each, n = left, 1
            open_at[room][kind] -= n
            if not open_at[room][kind]:
                del open_at[room][kind]
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(i)
            put(room - each * length, (*kind, (length, each)), n)
            left -= each * n
    for kinds in open_at.values():
        full.update(kinds)
    return full


def _fill(kind: tuple) -> int:
    return sum(a * n for a, n in kind)


class _Underfull:
    """Underfull bin types by room, and a table with a row for each thing that one of them can give back: nothing, a
    piece, or two of them. Rows of types that are gone are marked and cleared out in time."""

    def __init__(self, size: int):
        self.size, self.rows, self.n = size, np.zeros((1024, 5), np.int64), 0  # given back, room, number of the type, its fill, pieces
        self.kinds: list[tuple | None] = []
        self.back: list[tuple[int, ...]] = []
        self.number: dict[tuple, int] = {}
        self.span: dict[tuple, tuple[int, int]] = {}

    def add(self, kind: tuple) -> None:
        fill, k = _fill(kind), len(self.kinds)
        self.kinds.append(kind)
        self.number[kind] = k
        own = [a for a, _ in kind]
        gifts = [(), *((b,) for b in own), *((b, c) for i, b in enumerate(own) for c in own[i:] if b != c or kind[i][1] > 1)]
        if self.n + len(gifts) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((max(len(self.rows), len(gifts)), 5), np.int64)))
        self.rows[self.n : self.n + len(gifts)] = [(sum(g), self.size - fill, k, fill, len(g)) for g in gifts]
        self.span[kind] = (self.n, self.n + len(gifts))
        self.back += gifts
        self.n += len(gifts)

    def remove(self, kind: tuple) -> None:
        a, b = self.span.pop(kind)
        self.rows[a:b, 1] = -1
        self.kinds[self.number.pop(kind)] = None
        if self.n > 4096 and (self.rows[: self.n, 1] < 0).sum() * 2 > self.n:
            alive = list(self.span)
            self.__init__(self.size)
            for k in alive:
                self.add(k)

    def partner(self, victim: tuple, single: bool) -> tuple | None:
        """(gain, type, given, given back): the exchange that fills a bin no emptier than the victim's most."""
        rows, fill, best = self.rows[: self.n], _fill(victim), None
        allowed = (rows[:, 1] > 0) & (rows[:, 3] >= fill)
        if single:
            allowed &= rows[:, 2] != self.number[victim]
        at = np.flatnonzero(allowed)
        back, room, pieces = rows[at, 0], rows[at, 1], rows[at, 4]
        own = [a for a, _ in victim]
        gifts = [(a,) for a in own] + [(a, c) for i, a in enumerate(own) for c in own[i:] if a != c or victim[i][1] > 1]
        for give in gifts:
            gain = sum(give) - back
            gain[(gain > room) | (gain <= 0)] = 0
            if len(give) == 2:  # two for two is none of the exchanges, and two for nothing is two moves
                gain[pieces != 1] = 0
            i = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[i] > 0 and (best is None or gain[i] > best[0]):
                best = (int(gain[i]), self.kinds[rows[at[i], 2]], give, self.back[at[i]])
        return best


def _changed(kind: tuple, minus: tuple[int, ...], plus: tuple[int, ...]) -> tuple:
    c = Counter(dict(kind))
    c.subtract(minus)
    c.update(plus)
    return _sorted(c)


def local_search(bins: Counter, size: int) -> tuple[Counter, int]:
    """(bins, steps). The emptiest underfull bins give pieces to fuller ones: a move, or one for one, two for one or one
    for two, always so that the fuller bin gains most. Each step raises the sum of squared fills, so it comes to an end:
    when the number of bins is the least that the tokens allow, or no exchange is left among all underfull bins."""
    bins, steps = Counter(bins), 0
    total = sum(_fill(k) * n for k, n in bins.items())
    least, count = -(-total // size), sum(bins.values())
    table, queue = _Underfull(size), []
    for kind in bins:
        if _fill(kind) < size:
            table.add(kind)
            heappush(queue, (_fill(kind), kind))
    stuck: list = []
    while count > least and queue:
        fill, victim = heappop(queue)
        if victim not in table.number:
            continue
        found = table.partner(victim, bins[victim] < 2)
        if found is None:
            stuck.append((fill, victim))
            continue
        _, k, give, take = found
        n = min(bins[victim] // 2 if k == victim else min(bins[victim], bins[k]), bins[victim])
        rest, fuller = _changed(victim, give, take), _changed(k, take, give)
        for old in (victim, k):
            bins[old] -= n
            if not bins[old]:
                del bins[old]
                if old in table.number:
                    table.remove(old)
        for new in (fuller, rest):
            if new:
                if new not in bins and _fill(new) < size:
                    table.add(new)
                    heappush(queue, (_fill(new), new))
                bins[new] += n
        count -= 0 if rest else n
        steps += 1
        if victim in table.number:
            heappush(queue, (fill, victim))
        for x in stuck:  # what has changed may be a partner for them
            heappush(queue, x)
        stuck = []
    return bins, steps


def packed_bins(counts: dict[int, int], size: int, parts: int = PARTS) -> Counter:
    """Each part of the pieces packed by best fit on its own, and their underfull bins closed by the local search. Should
    best fit over all pieces need fewer bins than that, the search goes on from there."""
    start: Counter = Counter()
    for part in parts_of(counts, parts):
        start.update(best_fit(part, size))
    found, steps = local_search(start, size)
    log.info("packing: %d sequences in parts, %d after %d steps of the local search", sum(start.values()), sum(found.values()), steps)
    whole = best_fit(counts, size)
    if sum(whole.values()) < sum(found.values()):
        found, steps = local_search(whole, size)
        log.info("packing: %d sequences as a whole, %d after %d steps", sum(whole.values()), sum(found.values()), steps)
    return found


def placement(bins: Counter) -> np.ndarray:
    """Rows of (length, first rank, bins, pieces of it in each, first sequence, offset), by length and rank."""
    ranks: Counter = Counter()
    rows, base = [], 0
    for kind in sorted(bins, reverse=True):
        at = 0
        for length, each in kind:
            rows.append((length, ranks[length], bins[kind], each, base, at))
            ranks[length] += bins[kind] * each
            at += length * each
        base += bins[kind]
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def place(rows: DataFrame, size: int = SIZE, salts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to stored rows with doc_id, piece, length and key."""
    spark = rows.sparkSession
    n = rows.count()
    salts = salts or max(1, n // 5_000)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "key"), F.lit(salts)).cast("int"))
    groups = stored(dealt.groupBy("length", "_salt").agg(F.count("*").alias("n")))
    counts = {int(r.length): int(r.n) for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = placement(packed_bins(counts, size))
    held = spark.sparkContext.broadcast(table)  # a bin type has fewer than sqrt(2 size) lengths; types follow the lengths, not the pieces
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "key")) - 1
    ranked = dealt.withColumn("_nth", nth.cast("long")).join(starts, F.expr("length = _l AND _salt = _s")).withColumn("_rank", F.col("_nth") + F.col("_before")).drop("_l", "_s", "_before", "_nth", "_salt")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        table = held.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = table[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            seq, at = row[:, 4] + nth // row[:, 3], row[:, 5] + length * (nth % row[:, 3])
            own = [batch.column(f) for f in batch.schema.names if f != "_rank"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(seq), pa.array(at)], [*[f for f in batch.schema.names if f != "_rank"], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{types}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (with_ids: and ids)."""
    return place(stored(pieces(docs, tokenizer, size, end, id_col, text_col, with_ids)), size).drop("key")
