"""Shared pieces: scratch tables, Arrow batch loops and vectorised word hashing.

Python operators here work on Arrow batches cut into chunks of a few MB, so that a worker's memory follows the
longest single text and not the partition. All hashes are functions of the content only: a task that runs again
after an executor is lost gives the same rows.
"""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: With one byte more for each text, a chunk's powers of the hash base take 2 x 4 MB.
CHUNK_BYTES = (1 << 19) - 1024
#: Records in an Arrow batch, and bytes; a worker holds a few batches at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_pow = np.ones(1, _U)
_inv = np.ones(1, _U)

#: True for the bytes of a word in `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def _lean() -> None:
    """Workers run one stage after another in the same process: what a stage frees goes back to the system, so that it is
    not held beside what the next one needs."""
    pa.set_memory_pool(pa.system_memory_pool())
    if sys.platform.startswith("linux"):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # larger blocks are mapped and unmapped each on its own
            libc.mallopt(-1, 4 << 20)  # free memory at the end of the heap that is kept


_lean()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none (as in tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="keyloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new place in the shared folder."""
    return f"{scratch_dir(spark)}/keyloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on Arrow batches to what workers of 500 MB can hold; never raises them."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Rows of 64 bits in the largest bitmap that joins broadcast, and in the largest that goes to Python workers (32 MB).
JOIN_WORDS, WORKER_WORDS = 1 << 20, 1 << 22
_BIT = "shiftleft(1L, cast(shiftrightunsigned({}, 58) AS int))"


def _words_for(n: int, most: int, least: int = 6) -> int:
    """Rows of 64 bits for n hashes, a power of two up to the bound; beyond it more hashes pass."""
    return min(most, 1 << max(least, n.bit_length()))


def _bitmap(hashes: DataFrame, words: int) -> DataFrame:
    """(_w, _b): rows of 64 bits for a table with a column `h`, built by one aggregation."""
    return hashes.where("h IS NOT NULL").groupBy(F.col("h").bitwiseAND(F.lit(words - 1)).alias("_w")).agg(F.expr(f"bit_or({_BIT.format('h')})").alias("_b"))


def flagged(rows: DataFrame, hashed: str, wanted: DataFrame, words: int | None = None) -> DataFrame:
    """Adds _maybe: true for each row whose `hashed` is among wanted.h, and for few others.

    What is broadcast is a bitmap of JOIN_WORDS rows at most, whatever the tables hold; callers join only the rows that
    pass with `wanted` itself, so texts of all others stay where they are at every size."""
    words = words or _words_for(wanted.count(), JOIN_WORDS)
    bits = F.broadcast(_bitmap(wanted, words))
    joined = rows.withColumn("_at", F.col(hashed).bitwiseAND(F.lit(words - 1))).join(bits, F.expr("_at = _w"), "left")
    return joined.withColumn("_maybe", F.expr(f"coalesce((_b & {_BIT.format(hashed)}) != 0, false)")).drop("_at", "_w", "_b")


class Bits:
    """A bitmap of 64-bit hashes for Python workers, with two bits for each hash; never wrong for what was put in."""

    def __init__(self, wanted: DataFrame, words: int | None = None):
        self.words = words or _words_for(4 * wanted.count(), WORKER_WORDS, 14)
        other = F.expr("shiftrightunsigned(h, 22) | shiftleft(shiftrightunsigned(h, 52), 58)")  # bits that the first leaves out
        both = wanted.select("h").unionByName(wanted.select(other.alias("h")))
        found = _bitmap(both, self.words).toArrow()  # at most WORKER_WORDS rows
        table = np.zeros(self.words, np.int64)
        table[found.column("_w").to_numpy()] = found.column("_b").to_numpy()
        self.table = table.view(_U)

    def _one(self, h: np.ndarray) -> np.ndarray:
        return (self.table[(h & _U(self.words - 1)).astype(np.int64)] >> (h >> _U(58))) & _U(1) == 1

    def has(self, h: np.ndarray) -> np.ndarray:
        """Flags of unsigned hashes."""
        return self._one(h) & self._one(h >> _U(22) | h >> _U(52) << _U(58))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows as one struct `_row` beside the given columns, so that no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"_row.`{n}`").alias(n) for n in names])


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with all of its parts nullable, as schemas written in text are."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, nullable(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, pa.field(kind.item_field.name, nullable(kind.item_type)))
    return kind


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 texts of a column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def cut(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` bytes; one longer text is a range of its own."""
    low, total = 0, 0
    for i, x in enumerate(texts):
        if total and total + len(x) > limit:
            yield low, i
            low, total = i, 0
        total += len(x) + 1
    if low < len(texts):
        yield low, len(texts)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        for base, name in ((_BASE, "_pow"), (pow(_BASE, -1, 1 << 64), "_inv")):
            steps = np.full(size, base, _U)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)
    return _pow, _inv


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of some texts: positions in `buf`, and `first[i]:first[i + 1]` as the words of text i."""

    def __init__(self, texts: list[bytes], inside: np.ndarray = NOT_SPACE, lower: bool = False):
        data = b"\n".join(texts) + b"\n"
        self.data = data.lower() if lower else data  # bytes.lower changes A-Z only
        self.buf = np.frombuffer(self.data, np.uint8)
        self.n = len(texts)
        within = inside[self.buf]
        edges = np.flatnonzero(within[1:] != within[:-1]) + 1
        if within[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 1)))
        self.first = np.searchsorted(self.starts, self.offsets)

    def doc(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def prefix_sums(self) -> np.ndarray:
        power, _ = _powers(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, _U)
        np.cumsum((self.buf.astype(_U) + _U(1)) * power[: len(self.buf)], out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray | None = None, ends: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
        """A hash for the bytes of each word, or of the given spans."""
        sums = self.prefix_sums() if sums is None else sums
        starts, ends = self.starts if starts is None else starts, self.ends if ends is None else ends
        _, inverse = _powers(len(self.buf) + 1)
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for each n consecutive values, len(hashes) - n + 1 in all."""
    k = len(hashes)
    if k < n:
        return np.zeros(0, _U)
    power, inverse = _powers(k + 1)
    sums = np.zeros(k + 1, _U)
    np.cumsum(mix(hashes, seed + 1) * power[:k], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[: k - n + 1], seed)


_WORD = re.compile(r"[^\W\d_]+")
_letter = _lower = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, and its small letter (0 where that is no single one or depends on its place)."""
    global _letter, _lower
    if _letter is None:
        every = "".join(map(chr, range(0x110000)))
        letter, lower = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint32)
        for m in _WORD.finditer(every):
            letter[m.start() : m.end()] = True
        for i in np.flatnonzero(letter).tolist():
            x = every[i].lower()
            if len(x) == 1 and i != 0x3A3:
                lower[i] = ord(x)
        _letter, _lower = letter, lower
    return _letter, _lower


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_hash(word: str) -> int:
    """The hash that letter_words gives a word that is `word` in small letters."""
    x = _points(word)
    power, _ = _powers(len(x) + 1)
    with np.errstate(over="ignore"):
        return int(mix(((x.astype(_U) + _U(1)) * power[: len(x)]).sum(keepdims=True, dtype=_U))[0])


def letter_words(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes, text numbers, starts, ends) of all runs of letters in small letters, by chunks;
    places are code points within the text."""
    letter, lower = _tables()
    low = 0
    while low < len(texts):
        high, size = low + 1, len(texts[low])
        while high < len(texts) and size + len(texts[high]) < CHUNK_BYTES:
            size += len(texts[high]) + 1
            high += 1
        whole = "\n".join(texts[low:high]) + "\n"
        x = _points(whole)
        within = np.concatenate(([False], letter[x]))
        edges = np.flatnonzero(within[1:] != within[:-1])
        starts, ends = edges[0::2], edges[1::2]
        small = lower[x]
        power, inverse = _powers(len(x) + 1)
        sums = np.zeros(len(x) + 1, _U)
        np.cumsum((small.astype(_U) + _U(1)) * power[: len(x)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
        odd = np.flatnonzero((small == 0) & letter[x])  # words with such letters are lowered one by one
        for k in np.unique(np.searchsorted(ends, odd, "right")).tolist():
            hashes[k] = word_hash(whole[starts[k] : ends[k]].lower())
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts[low:high]), np.int64, high - low) + 1)))
        doc = np.searchsorted(offsets, starts, "right") - 1
        yield low, hashes, doc, starts - offsets[doc], ends - offsets[doc]
        low = high


def runs_to_mask(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """True where a position is covered by a window of n from one of the starts."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + n, length), -1)
    return np.cumsum(steps[:-1]) > 0
