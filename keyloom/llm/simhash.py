"""Operator 8: SimHash near-duplicates by a positional byte index with count filtering.

Fingerprints of 64 bits link at `max_bits` or fewer differing bits, so linked ones share at least 8 - max_bits of their
8 bytes in place. Lists of a single (position, byte) hold n/256 rows each and would pair n^2/64; the index therefore
holds joint lists of up to three positions, chosen so that every set of 8 - max_bits equal bytes contains one (for four
equal bytes: Turan's 20 triples). Within a list each pair's equal bytes are tallied, pairs under the minimum are
dropped, the rest is verified bit by bit. A list gives a spanning forest of its links, never all pairs.

A list longer than `list_cap` isn't gathered at all: its fingerprints are joined through the midpoints of their links
instead. Any two at distance <= 2r have a common value within r of both, and any two within r of one value are within
2r of each other; so linking all that reach a value to the smallest of them is exact, and is one aggregation.

Copies share a fingerprint and are handled once. Nulls: a null text has no words; null ids take part but a component is
named by its smallest id that isn't null. No words: fingerprint 0, linked like any other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, cut, flagged, mix, packed, stored, texts_of, unpacked, windows

SHINGLE, MAX_BITS, LIST_CAP = 4, 4, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit j is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.lower().split()  # of bytes: lowers A-Z, splits at \x20 \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(values), 65536):
        counts += np.unpackbits(values[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(values)).tobytes(), "big")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions; any 8 - max_bits positions contain one of them."""
    equal = 8 - max_bits
    if equal < 4:
        return list(combinations(range(8), equal))
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    within = [c for g in groups for c in combinations(g, 3)]
    between = [(*pair, x) for k, g in enumerate(groups) for pair in combinations(g, 2) for x in groups[(k + 1) % 3]]
    return within + between


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span each component among distinct fingerprints. What is reached is taken out, so that a dense list
    is compared with few of its members."""
    out, rest = [], values
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            differ = rest ^ one
            tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= 8 - max_bits
            near[near] = np.bitwise_count(differ[near]) <= max_bits
            if near.any():
                new = rest[near]
                out.append((np.full(len(new), one), new))
                front.extend(new)
                rest = rest[~near]
    return out


def _lists(fps: DataFrame, max_bits: int, list_cap: int) -> DataFrame:
    """(a, b) links; rows with a null b are fingerprints of lists over the cap."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for k, places in enumerate(position_sets(max_bits)):
        key = F.lit(k).cast("long")
        for p in places:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def links(batches):
        key, held, over = None, [], False  # of the list that goes on

        def flush():
            if over or not held:
                return []
            values = np.concatenate(held).view(np.uint64)
            return _forest(values, max_bits) if len(values) > 1 else []

        for batch in batches:
            fp, keys = batch.column("fp").to_numpy(), batch.column("key").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            pairs, crowded = [], []
            last = len(cuts) - 2
            for i in np.unique(np.concatenate(([0], np.flatnonzero(np.diff(cuts) > 1), [last]))).tolist():
                part = fp[cuts[i] : cuts[i + 1]]
                if keys[cuts[i]] != key:
                    pairs += flush()
                    key, held, over = keys[cuts[i]], [], False
                held.append(part)
                if over or sum(map(len, held)) > list_cap:
                    crowded += held
                    held, over = [], True
                elif i < last:
                    pairs += flush()
                    key, held = None, []
            a = [np.concatenate([x for x, _ in pairs]).view(np.int64)] if pairs else []
            b = [np.concatenate([y for _, y in pairs]).view(np.int64)] if pairs else []
            a, b = pa.array(np.concatenate([*a, *crowded]) if a or crowded else [], pa.int64()), b[0] if b else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([a, pa.array(b.tolist() + [None] * (len(a) - len(b)), pa.int64())], ["a", "b"])
        pairs = flush()
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in pairs]).view(np.int64)), pa.array(np.concatenate([y for _, y in pairs]).view(np.int64))], ["a", "b"])

    return posted.mapInArrow(links, "a long, b long")


def _midpoint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Exact links of any number of fingerprints: each to the smallest that shares a value within max_bits / 2."""
    masks = [reduce(lambda x, b: x | 1 << b, bits, 0) for r in range(max_bits // 2 + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # A fingerprint's values are sent with the smallest fingerprint first found there; the merge is a plain minimum.
    reach = fps.select("fp", F.explode(F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: m.bitwiseXOR(F.col("fp")))).alias("mid"))
    low = reach.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").select("mid", "b")
    return reach.join(low, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large-star and small-star rounds."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        edges = stored(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _print_roots(fps: DataFrame, max_bits: int, list_cap: int) -> DataFrame:
    """(node, root) of the fingerprints that have a link; fps.fp are distinct."""
    found = stored(_lists(fps.select("fp"), max_bits, list_cap))
    links = found.where("b IS NOT NULL")
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if crowded.limit(1).count():
        links = links.unionByName(_midpoint_links(crowded, max_bits))
    return components(links)


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, list_cap: int = LIST_CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    if max_bits not in (0, 2, 4, 6):
        raise ValueError("max_bits is 0, 2, 4 or 6")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def prints(batches):
        for batch in batches:
            values = [fingerprint(x, shingle) for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = stored(source.mapInArrow(prints, "doc_id long, fp long"))
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = _print_roots(fps, max_bits, list_cap)
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near groups: words of a shingle, bits of a parity sketch (at least and at most), cells of the tally, cells of a block.
NEAR_SHINGLE, SKETCH_LOW, SKETCH_HIGH, TALLY_BITS, BLOCK_BITS = 5, 512, 1 << 16, 23, 18
#: Bytes of shingle sets that a task holds; a larger group is compared by several tasks, in rounds.
GROUP_BYTES = 8 << 20
#: Distinct texts a task remembers, so as not to send copies.
SEEN = 100_000


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's five-word shingles; a shorter text is one shingle."""
    for low, high in cut(texts):
        w = Words(texts[low:high], lower=True)
        hashes = w.hashes()
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            yield np.unique(windows(hashes[a:b], min(NEAR_SHINGLE, b - a))) if b > a else np.zeros(1, np.uint64)


def _fresh(batch: pa.RecordBatch, seen: set) -> tuple[list[int], list[bytes]]:
    """Nodes and texts of a batch that the task has not sent yet."""
    rows = []
    for i, node in enumerate(batch.column("node").to_pylist()):
        if node not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            rows.append(i)
    part = batch.take(pa.array(rows, pa.int64()))
    return part.column("node").to_pylist(), texts_of(part, "text")


def _cell(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values, 5) >> np.uint64(64 - bits)).astype(np.int64)


def _tally(texts: DataFrame, bits: int) -> np.ndarray:
    """How many texts hold the shingles of each of 2^bits cells, as 1 for one and by sixteenths of a power of two above:
    8 MB whatever the corpus. Copies in one task count once. This only orders shingles, and every task sees the same."""
    block_bits = min(BLOCK_BITS, bits)

    def tasks(batches):
        counts, seen = np.zeros(1 << bits, np.uint8), set()
        for batch in batches:
            for x in _joined(shingle_sets(_fresh(batch, seen)[1])):
                cells, n = np.unique(_cell(x, bits), return_counts=True)
                counts[cells] = np.minimum(255, counts[cells] + n)
        for block in range(1 << (bits - block_bits)):
            part = counts[block << block_bits : (block + 1) << block_bits]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": [block], "n": [part.tobytes()]})

    def level(block, total):
        steps = np.where(total > 0, 1 + 16 * np.log2(np.maximum(total, 1)), 0)
        return pa.RecordBatch.from_pydict({"block": [block], "n": [np.minimum(steps, 255).astype(np.uint8).tobytes()]})

    def merge(batches):
        now, total = None, None
        for batch in batches:
            for block, n in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist()):
                if block != now:
                    if now is not None:
                        yield level(now, total)
                    now, total = block, np.zeros(1 << block_bits, np.int64)
                total += np.frombuffer(n, np.uint8)
        if now is not None:
            yield level(now, total)

    parts = texts.mapInArrow(tasks, "block long, n binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros(1 << bits, np.uint8)
    for r in stored(parts.mapInArrow(merge, "block long, n binary")).toLocalIterator():
        out[r.block << block_bits : (r.block + 1) << block_bits] = np.frombuffer(r.n, np.uint8)
    return out


def _joined(sets: Iterator[np.ndarray], most: int = 1 << 19) -> Iterator[np.ndarray]:
    held, size = [], 0
    for x in sets:
        held.append(x)
        size += len(x)
        if size > most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _prefix(values: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The rarest fifth of a set's shingles: two sets of similarity 0.8 share one of them. Those in no other text go."""
    n, m = counts[_cell(values, bits)], len(values)
    first = np.lexsort((values, n))[: m - (4 * m + 4) // 5 + 1]
    return values[first[n[first] > 1]]


def _sketch(values: np.ndarray) -> bytes:
    """The parity of the shingles in each of so many cells; a shingle in one of two sets only turns one bit."""
    bits = min(SKETCH_HIGH, max(SKETCH_LOW, 1 << (len(values) - 1).bit_length()))
    cells = (mix(values, 6) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch with fewer cells: halves are added up."""
    x = np.frombuffer(sketch, np.uint64)
    while x.nbytes > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal keys; those of a single row are left out."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for i in np.unique(np.concatenate(([0], np.flatnonzero(np.diff(cuts) > 1), [len(cuts) - 2]))).tolist():
            if keys[cuts[i]] != key:
                if sum(map(len, held)) > 1:
                    yield pa.Table.from_batches(held)
                key, held = keys[cuts[i]], []
            held.append(batch.slice(cuts[i], cuts[i + 1] - cuts[i]))
    if sum(map(len, held)) > 1:
        yield pa.Table.from_batches(held)


def _members(list_cap: int):
    """Lists of two and more nodes, named by their members: shingles with the same members are one list. A list that is
    longer than the cap is not held: `star` is its first node, to which all others are linked."""

    def names(keys, nodes):
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
        keys, nodes = keys[new], nodes[new]
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        sums = mix(np.add.reduceat(mix(nodes.view(np.uint64), 3), starts), 4)
        many = np.repeat(sizes > 1, sizes)
        out = np.unique(np.column_stack((np.repeat(sums.view(np.int64), sizes)[many], nodes[many])), axis=0)
        return batch_of(np.ascontiguousarray(out[:, 0]), np.ascontiguousarray(out[:, 1]), None)

    def batch_of(keys, nodes, star):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array([star] * len(keys), pa.int64())], ["key", "node", "star"])

    def run(batches):
        key, rest, size, star = None, [], 0, None  # of the last key, which may go on

        def flush():
            if star is not None:
                return [batch_of(k, n, star) for k, n in rest]
            return [names(*(np.concatenate(x) for x in zip(*rest)))] if rest else []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            low = 0
            if size and key == keys[0]:  # the held list goes on
                low = int(np.searchsorted(keys, keys[0], "right"))
                rest.append((keys[:low], nodes[:low]))
                size += low
            last = int(np.searchsorted(keys, keys[-1]))
            if low <= last:
                yield from flush()
                if low < last:
                    yield names(keys[low:last], nodes[low:last])
                key, rest, size, star = keys[-1], [(keys[last:], nodes[last:])], len(keys) - last, None
            if size > list_cap:
                star = int(rest[0][1][0]) if star is None else star
                yield from flush()
                rest = []
        yield from flush()

    return run


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span the members of each list that can have similarity 0.8 by their sizes and sketches."""
    for run in _runs(batches):
        node, m = run.column("node").to_numpy(), run.column("m").to_numpy()
        order = np.argsort(m, kind="stable")
        node, m, held = node[order], m[order], [run.column("sketch")[int(i)].as_py() for i in order]
        folded: dict[int, np.ndarray] = {}  # by size: sketches of members that differ in size are folded to the smallest
        rest = np.arange(len(node))
        while len(rest) > 1:
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                one = front.pop()
                near = 5 * np.minimum(m[rest], m[one]) >= 4 * np.maximum(m[rest], m[one])
                some = rest[near]
                if not len(some):
                    continue
                size = min(len(held[one]), min(len(held[i]) for i in (some[0], some[-1])))
                if size not in folded:
                    folded[size] = np.zeros((len(node), size // 8), np.uint64)
                    for i, x in enumerate(held):
                        if len(x) >= size:
                            folded[size][i] = _folded(x, size)
                table = folded[size]
                differ = np.bitwise_count(table[some] ^ table[one]).sum(axis=1, dtype=np.int64)
                some = some[differ * 9 <= m[some] + m[one]]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), node[one])), pa.array(node[some])], ["a", "b"])
                    front.extend(some.tolist())
                    rest = rest[~np.isin(rest, some)]


class _Index:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def keep(self, alive: np.ndarray) -> None:
        held = alive[self.owner]
        self.flat, self.owner = self.flat[held], self.owner[held]

    def near(self, values: np.ndarray) -> np.ndarray:
        """Flags of the sets that have similarity 0.8 or more with this one."""
        low, high = np.searchsorted(self.flat, values), np.searchsorted(self.flat, values, "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        return shared * 9 >= 4 * (self.sizes + len(values))


def _roots(sets: list[np.ndarray]) -> np.ndarray:
    """The first member of each set's component."""
    index, root, rest = _Index(sets), np.arange(len(sets)), np.ones(len(sets), bool)
    alive = len(sets)
    for head in range(len(sets)):
        if not rest[head]:
            continue
        rest[head] = False
        front = [head]
        while front and rest.any():
            new = np.flatnonzero(index.near(sets[front.pop()]) & rest)
            root[new] = head
            rest[new] = False
            front.extend(new.tolist())
            if rest.sum() * 2 < alive:  # what is settled is looked up no more
                alive = int(rest.sum())
                index.keep(rest)
    return root


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root): components of each group's nodes by the similarity of their shingle sets."""

    def sent():
        root = _roots(sets)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array(nodes, np.int64)[root])], ["node", "root"])

    key, nodes, sets = None, [], []
    for batch in batches:
        for k, node, values in zip(batch.column("key").to_pylist(), batch.column("node").to_pylist(), batch.column("values")):
            if k != key:
                if nodes:
                    yield sent()
                key, nodes, sets = k, [], []
            if not nodes or nodes[-1] != node:  # the set of a text that several tasks sent counts once
                nodes.append(node)
                sets.append(np.frombuffer(values.as_py(), np.uint64))
    if nodes:
        yield sent()


def _pivot_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a part of a group and the group's pivots, which come first; enough of them to join what they join."""
    part, pivots, names, index, up = None, [], [], None, []

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for batch in batches:
        a, b = [], []
        for key, salt, pivot, node, values in zip(*(batch.column(k).to_pylist() for k in ("key", "salt", "pivot", "node", "values"))):
            if (key, salt) != part:
                part, pivots, names, index = (key, salt), [], [], None
            x = np.frombuffer(values, np.uint64)
            if pivot:
                pivots.append(x)
                names.append(node)
                continue
            if not pivots:
                continue
            if index is None:
                index, up = _Index(pivots), list(range(len(pivots)))
            found = np.flatnonzero(index.near(x)).tolist()
            tops = {}
            for i in found:
                if names[i] != node:
                    tops.setdefault(top(i), i)
            for i in tops.values():
                a.append(node)
                b.append(names[i])
            own = [top(i) for i in found]
            for i in own:  # the member itself joins them
                up[i] = own[0]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _in_rounds(sets: DataFrame, group_bytes: int) -> DataFrame:
    """(node, root) for groups of any size: a table (key, node, values), stored.

    A round takes pivots of a group, as many as a task can hold, and compares them with all of the group, in parts of
    that size; what a pivot links is exact, as it has then met every member. Members that hang together already need not
    meet, so only those outside of their group's largest component become pivots, until there are none: a dense group
    takes one pivot."""
    sizes = stored(sets.groupBy("key").agg(F.sum(F.octet_length("values")).alias("bytes")).withColumn("parts", F.ceil(F.col("bytes") / group_bytes).cast("int")))
    nodes = stored(sets.select("key", "node", F.octet_length("values").alias("size")))
    links, done, roots = None, None, None
    while True:
        if links is None:
            pivots = nodes.groupBy("key").agg(F.min("node").alias("node"))
        else:
            roots = components(links)
            named = stored(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
            counts = named.groupBy("key", "root").agg(F.count("*").alias("n"))
            largest = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("x")).select("key", F.col("x.root").alias("most"))
            left = named.join(largest, "key").where("root <> most").join(done, ["key", "node"], "left_anti").select("key", "node", "size")
            left = stored(left)
            if left.limit(1).count() == 0:
                return named.select("node", "root")
            share = left.groupBy("key").agg(F.sum("size").alias("total"), F.min("node").alias("first"))
            dealt = left.join(share, "key").where(f"node = first OR pmod(xxhash64(node), greatest(1, ceil(total / {group_bytes}))) = 0")
            pivots = dealt.select("key", "node")
        pivots = stored(pivots)
        done = pivots if done is None else stored(done.unionByName(pivots))
        held = sets.join(pivots, ["key", "node"], "left_semi").join(sizes, "key")
        first = held.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("pivot"), "node", "values")
        rest = sets.join(sizes, "key").select("key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("pivot"), "node", "values")
        met = first.unionByName(rest).repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("pivot"), "node")
        found = met.mapInArrow(_pivot_links, "a long, b long")
        links = stored(found if links is None else links.unionByName(found))


def _textual(docs: DataFrame, id_col: str, text_col: str) -> dict:
    """doc_id, node (the text's hash) and h (that of both), to be computed from any table with the columns of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(id_col).cast("long")
    return {"doc_id": number, "node": F.xxhash64(text), "h": F.xxhash64(number, F.xxhash64(text), number.isNull()), "text": text}


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_cap: int = LIST_CAP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(node, root) for the hashes of distinct texts: components of those whose sets of five-word shingles have a
    similarity of 0.8 or more; texts without a partner are left out.

    Exact, up to collisions of 64-bit hashes: two such sets share one of the first fifth of their shingles in any one
    order (here by how many texts hold them, then by hash), so the lists of those shingles hold all pairs. Within a list,
    sizes and parity sketches rule out only what can't reach 0.8; the rest forms groups, and in a group the sets
    themselves are compared. Lists over `list_cap` are linked whole, and groups over `group_bytes` go in rounds."""
    spark = docs.sparkSession
    parts = _textual(docs, id_col, text_col)
    texts = docs.select(parts["node"].alias("node"), parts["text"].alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(TALLY_BITS, max(16, (int(total) // 8).bit_length()))
    tally = spark.sparkContext.broadcast(_tally(texts, bits))

    def posts(batches):
        seen = set()
        for batch in batches:
            nodes, found = _fresh(batch, seen)
            sizes, keys, sketches = [], [], []
            for x in shingle_sets(found):
                sizes.append(len(x))
                keys.append(_prefix(x, tally.value, bits).view(np.int64))
                sketches.append(_sketch(x))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "m", "sketch", "keys"])

    def sets(batches):
        seen = set()
        for batch in batches:
            nodes, found = _fresh(batch, seen)
            out = [x.tobytes() for x in shingle_sets(found)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], ["node", "values"])

    posted = stored(texts.mapInArrow(posts, "node long, m long, sketch binary, keys array<long>").where("size(keys) > 0"))
    listed = posted.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    lists = stored(listed.mapInArrow(_members(list_cap), "key long, node long, star long").distinct())
    known = posted.select("node", "m", "sketch").join(lists.where("star IS NULL").select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    short = lists.where("star IS NULL").join(known, "node").select("key", "node", "m", "sketch").repartition("key").sortWithinPartitions("key", "node")
    stars = lists.where("star IS NOT NULL").select(F.col("node").alias("a"), F.col("star").alias("b"))
    groups = components(stored(short.mapInArrow(_plausible, "a long, b long").unionByName(stars)))
    groups = stored(groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct().select("node", F.col("root").alias("key")))
    # Sets are made again for texts that may be in a group, and only those travel.
    chosen = flagged(texts, "node", groups.select(F.col("node").alias("h"))).where("_maybe").select("node", "text").mapInArrow(sets, "node long, values binary")
    held = stored(chosen.join(groups, "node").select("key", "node", "values"))
    sizes = held.groupBy("key").agg(F.sum(F.octet_length("values")).alias("bytes")).where(F.col("bytes") > group_bytes)
    large = stored(sizes.select("key"))
    some = large.limit(1).count() > 0
    near = (held.join(large, "key", "left_anti") if some else held).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_exact, "node long, root long")
    if some:
        near = near.unionByName(_in_rounds(stored(held.join(large, "key", "left_semi").dropDuplicates(["key", "node"])), group_bytes))
    return stored(near)


def print_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """(a, b) for the hashes of distinct texts: links that span the components of the fingerprints of operator 8."""
    parts = _textual(docs, id_col, text_col)

    def prints(batches):
        seen = set()
        for batch in batches:
            nodes, found = _fresh(batch, seen)
            values = np.array([fingerprint(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values)], ["node", "fp"])

    rows = stored(docs.select(parts["node"].alias("node"), parts["text"].alias("text")).mapInArrow(prints, "node long, fp long"))
    fps = stored(rows.groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high")))
    roots = _print_roots(fps, max_bits, list_cap)
    # Only fingerprints of several texts, or with a link, are named; each text of theirs is linked to one of the component's.
    named = fps.join(roots, fps.fp == roots.node, "left").where("low <> high OR root IS NOT NULL").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = stored(named)
    heads = named.groupBy("root").agg(F.min("low").alias("b"))
    return rows.join(named.join(heads, "root").select("fp", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, **options) -> DataFrame:
    """(node, root) for the hashes of distinct texts: components of the links by fingerprints, as in operator 8, and of
    those by sets of five-word shingles, which hold the near copies that lie further apart than the fingerprints reach."""
    sets = near_classes(docs, id_col, text_col, **options)
    links = print_links(docs, id_col, text_col, max_bits, options.get("list_cap", LIST_CAP))
    return stored(components(links.unionByName(sets.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, component_id), a row for each document; a component is named by the smallest id in it."""
    parts = _textual(docs, id_col, text_col)
    rows = docs.select(parts["doc_id"].alias("doc_id"), parts["node"].alias("node"))
    lows = rows.groupBy("node").agg(F.min("doc_id").alias("low"))
    named = stored(lows.join(near_classes(docs, id_col, text_col, **options), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=near_duplicates, **options) -> DataFrame:
    """The columns of docs: of each group of near-duplicates one row stays, that with the smallest id, then text hash.

    Documents are told apart by id and text, so unrelated texts under one id are judged each on its own. Rows without an
    id go if their group has one with an id; a group without ids keeps one row. Of rows alike in id and text one stays.
    Decisions travel, texts don't: only rows that may be dropped or repeated (a bitmap of bounded size says which) are
    joined with them."""
    names, parts = docs.columns, _textual(docs, id_col, text_col)
    keyed = {k: parts[k] for k in ("doc_id", "node", "h")}
    rows = stored(docs.select(*[c.alias(k) for k, c in keyed.items()]).groupBy("doc_id", "node", "h").agg(F.count("*").alias("n")))
    by_text = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "h")).alias("low"))
    named = stored(by_text.join(classes(docs, id_col, text_col, **options), "node", "left").select("low", F.coalesce("root", "node").alias("root")))
    kept = stored(named.groupBy("root").agg(F.min("low").alias("low")).select("low.h"))
    gone = rows.join(kept, "h", "left_anti").select("h")
    twice = stored(rows.join(kept, "h", "left_semi").where("n > 1").select("h"))
    doubtful = stored(gone.unionByName(twice))
    marked = flagged(packed(docs, h=parts["h"]), "h", doubtful)
    out = marked.where("NOT _maybe").select("_row").unionByName(marked.where("_maybe").join(doubtful, "h", "left_anti").select("_row"))
    if twice.limit(1).count():
        again = marked.where("_maybe").join(twice, "h", "left_semi").groupBy("h").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        out = out.unionByName(again.select("_row"))
    return unpacked(out, names)
