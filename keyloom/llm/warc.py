"""Operator 4: WARC files, and a fixity audit of them with Merkle trees.

Pages become WARC 1.1 response records, FILE_RECORDS ids to a file, in order of id; a record's offset range follows from
the lengths before it in its file. `write` stores them as files of records (gzip or plain), `read` takes any WARC file
apart again, gzip members included, and hashes what stands there.

A leaf is the SHA-256 of 00 and the record's bytes. A node is the SHA-256 of 01, its
offset range and its children's digests, for FANOUT neighbouring children; file roots go on to be the leaves of one tree
over all files, up to a single root. Trees of two replicas are compared from the root; only children of nodes that
differ are joined on the next level down, so an intact archive costs one comparison beyond the hashing.

Replicas are matched by place: (file, number within the file). A record that one replica lacks, or that has another
length, shows as a differing leaf, as do all that follow it in its file if offsets moved.

Nulls: a null url or html is written as an empty one; pages without an id are not archived, as a record needs a place.
Repeated ids: all are records, ordered by id, then digest. Two empty archives agree; no rows. Extra columns are ignored.
A file that is cut short or damaged beyond a header ends with one record that holds the rest of its bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: 2^FILE_BITS ids go to a file.
FILE_BITS, FANOUT = 8, 16
DATE, END = "1970-01-01T00:00:00Z", "\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)", re.IGNORECASE)


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """The bytes of a response record, as a string column in UTF-8. Its id is a UUID from a digest of page id and url."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    payload = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), body)
    uuid = F.regexp_replace(F.md5(F.concat_ws(" ", page_id.cast("string"), url).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    lines = ["WARC/1.1", "WARC-Type: response", F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), f"WARC-Date: {date}", F.concat(F.lit("WARC-Target-URI: "), url), "Content-Type: application/http;msgtype=response", F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"))]
    head = F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    return F.concat(head, F.lit(END), payload, F.lit(END))


def _records(pages: DataFrame) -> DataFrame:
    rows = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), record(F.col("page_id").cast("long"), F.col("url"), F.col("html")).alias("r"))
    return rows.select("page_id", F.shiftright("page_id", FILE_BITS).alias("file"), "r", F.sha2(F.concat(F.lit(b"\x00"), F.col("r").cast("binary")), 256).alias("digest"))


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Stores the pages as WARC files under path, in a folder for each file number."""
    rows = _records(pages).repartition("file").sortWithinPartitions("file", "page_id", "digest")
    bodies = rows.select("file", F.expr(f"left(r, length(r) - {len(END)})").alias("value"))
    bodies.write.partitionBy("file").option("lineSep", END).option("compression", compression).text(path)


def split(content: bytes) -> list[tuple[int, int]]:
    """Ranges of the records of a WARC file that is no longer compressed."""
    out, at = [], 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        length = _LENGTH.search(content, at, head) if head >= 0 and content.startswith(b"WARC/", at) else None
        end = head + 4 + int(length[1]) + 4 if length else len(content)
        if not length or end > len(content) or content[end - 4 : end] != b"\r\n\r\n":
            end = len(content)
        out.append((at, end))
        at = end
    return out


def _plain(content: bytes) -> bytes:
    if not content.startswith(b"\x1f\x8b"):
        return content
    try:
        return gzip.decompress(content)  # all members
    except (OSError, EOFError, zlib.error):
        return content  # damaged: its bytes as they are


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, start, size, digest) of the records in the WARC files under path, from their bytes. A task holds one
    file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", r"file=(-?[0-9]+)/[^/]*$", 1).cast("long").alias("file"), "content")

    def leaves_of(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                data = _plain(content.as_py())
                rows = [(file, k, a, b - a, hashlib.sha256(b"\x00" + data[a:b]).hexdigest()) for k, (a, b) in enumerate(split(data))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["file", "place", "start", "size", "digest"]) if rows else pa.RecordBatch.from_pydict({n: pa.array([], t) for n, t in (("file", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("digest", pa.string()))})

    return files.mapInArrow(leaves_of, "file long, place long, start long, size long, digest string")


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(pages: DataFrame) -> DataFrame:
    """page_id, file, place, start, size, digest of the records that pages make; a window holds one file's rows without bodies."""
    rows = _records(pages).select("page_id", "file", F.octet_length("r").cast("long").alias("size"), "digest")
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    return rows.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("place"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"), "size", "digest")


def _up(level: DataFrame, keys: list[str]) -> DataFrame:
    """Parents of (keys, node, start, stop, digest): each gathers FANOUT children at most."""
    kids = F.sort_array(F.collect_list(F.struct("node", "start", "stop", "digest")))
    parents = level.groupBy(*keys, F.expr(f"node div {FANOUT}").alias("up")).agg(kids.alias("kids"))
    start, stop = F.col("kids")[0]["start"], F.element_at("kids", -1)["stop"]
    text = F.concat_ws("\n", start.cast("string"), stop.cast("string"), F.array_join(F.transform("kids", lambda k: k["digest"]), "\n"))
    return parents.select(*keys, F.col("up").alias("node"), start.alias("start"), stop.alias("stop"), _sha(F.lit(b"\x01"), text.cast("binary")).alias("digest"))


def trees(rows: DataFrame, most: int, low: int, high: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels from the leaves up: of all files' own trees (keyed by file), then of the tree over files low..high.

    most: the largest place in any file. All replicas get the same bounds, so their levels match."""
    own = [rows.select("file", F.col("place").alias("node"), "start", (F.col("start") + F.col("size")).alias("stop"), "digest")]
    while most > 0:
        own.append(stored(_up(own[-1], ["file"])))
        most //= FANOUT
    files = [own[-1].select((F.col("file") - F.lit(low)).alias("node"), F.col("file").alias("start"), F.col("file").alias("stop"), "digest")]
    most = high - low
    while most > 0:
        files.append(stored(_up(files[-1], [])))
        most //= FANOUT
    return own, files


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes that differ or that one side lacks."""
    left = a.select(*keys, "start", "stop", "digest")
    right = b.select(*keys, F.col("start").alias("s"), F.col("stop").alias("z"), F.col("digest").alias("d"))
    return left.join(right, keys, "full").where("NOT (digest <=> d AND start <=> s AND stop <=> z)").select(*keys)


def _descend(a: list[DataFrame], b: list[DataFrame], keys: list[str], top: DataFrame | None = None) -> DataFrame:
    """Keys of differing leaves; on each level only children of differing nodes are compared. top: where to begin."""
    found = None
    for x, y in zip(reversed(a), reversed(b)):
        if found is not None:
            parent = found.withColumnRenamed("node", "up")
            x, y = (level.withColumn("up", F.expr(f"node div {FANOUT}")).join(parent, [*keys, "up"], "left_semi").drop("up") for level in (x, y))
        elif top is not None:
            x, y = (level.join(top, keys, "left_semi") for level in (x, y))
        found = stored(_differ(x, y, [*keys, "node"]))
        if found.limit(1).count() == 0:
            break
    return found


@dataclass
class Audit:
    """rows: the first replica's leaves; bad: (file, place) of the leaves that differ; the digests of both roots."""

    rows: DataFrame
    bad: DataFrame
    root: str | None
    other_root: str | None

    def ranges(self) -> DataFrame:
        """(file, first, last, start, stop): runs of neighbouring records that differ, with their offsets."""
        own = self.bad.join(self.rows, ["file", "place"], "left")
        run = F.col("place") - F.row_number().over(Window.partitionBy("file").orderBy("place"))
        found = own.withColumn("run", run).groupBy("file", "run").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("stop"))
        return found.drop("run")


def audit(mine: DataFrame, other: DataFrame) -> Audit:
    """Compares the leaves of two replicas (of `leaves` or `read`) through their trees."""
    mine, other = stored(mine), stored(other.select("file", "place", "start", "size", "digest"))
    every = mine.select("file", "place").unionByName(other.select("file", "place"))
    most, low, high = every.agg(F.max("place"), F.min("file"), F.max("file")).first()
    if most is None:
        return Audit(mine, mine.select("file", "place"), None, None)
    own_a, files_a = trees(mine, most, low, high)
    own_b, files_b = trees(other, most, low, high)
    tops = [next((r.digest for r in t[-1].select("digest").collect()), None) for t in (files_a, files_b)]  # a row each
    if tops[0] == tops[1]:
        return Audit(mine, mine.select("file", "place").limit(0), *tops)
    files = _descend(files_a, files_b, []).select((F.col("node") + F.lit(low)).alias("file"))
    return Audit(mine, _descend(own_a, own_b, ["file"], files).select("file", F.col("node").alias("place")), *tops)


def report(mine: DataFrame, other: DataFrame) -> DataFrame:
    """One row for each record of the first replica: page_id, file, place, start, size, digest, intact."""
    found = audit(mine, other)
    marked = found.rows.join(found.bad.withColumn("differs", F.lit(True)), ["file", "place"], "left")
    return marked.select("page_id", "file", "place", "start", "size", "digest", F.col("differs").isNull().alias("intact"))


def damaged(pages: DataFrame) -> DataFrame:
    """Pages with faults planted by id, to store as a replica: in every 97th page one letter of the body is changed."""
    return pages.withColumn("html", F.expr("if(page_id % 97 = 5 AND length(html) > 0, concat('#', substring(html, 2)), html)"))
