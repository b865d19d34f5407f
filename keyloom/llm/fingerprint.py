"""Operator 2: canonical exact digests of documents, with DataFrame functions only.

A canonical text is NFKC-composed, case-folded and composed again, runs of white space become one blank, and the ends
are trimmed. Its digest is two chained 64-bit xxhash values (128 bits). Texts in one digest bucket are compared byte
by byte; if different texts ever meet in a bucket, their fingerprints get the text's rank there as a suffix.

Nulls: a null text is the empty text. A row with a null id keeps its row and takes the empty text as its successor.
Repeated ids: the successor is the next larger id; of several rows with that id, the one with the smallest text counts.
An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flagged, stored

#: Ids of one window sort share all but this many low bits; parents share that many more.
BUCKET_BITS, LEVEL_BITS = 8, 12


def canonical(text: Column) -> Column:
    """ICU's composition and full case folding, reached by SQL's reflect()."""
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold(nfkc(text))), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits as a struct of two longs; the second hash takes another as its seed."""
    return F.struct(F.xxhash64(canon).alias("hi"), F.xxhash64(F.lit("wide"), canon).alias("lo"))


def _hex(value: Column) -> Column:
    part = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.concat(part(value["hi"]), part(value["lo"]))


def _next_heads(heads: DataFrame, bits: int) -> DataFrame:
    """(b, head) with the head of the next bucket; a window holds one parent's children at most, as deep as needed."""
    own = Window.partitionBy(F.shiftright("b", LEVEL_BITS)).orderBy("b")
    out = heads.withColumn("follow", F.lead("head").over(own)).withColumn("p", F.shiftright("b", LEVEL_BITS))
    if bits <= LEVEL_BITS:
        return out.select("b", "head", "follow")
    above = _next_heads(heads.groupBy(F.shiftright("b", LEVEL_BITS).alias("b")).agg(F.min("head").alias("head")), bits - LEVEL_BITS)
    return out.join(above.select(F.col("b").alias("p"), F.col("follow").alias("up")), "p", "left").select("b", "head", F.coalesce("follow", "up").alias("follow"))


def _edited() -> Column:
    half = "cast(floor(length(text) / 2) as int)"
    return F.expr(f"concat(left(text, length(text) - {half}), left(succ, {half}))")


def _measured(both: DataFrame, *more: str) -> DataFrame:
    """(doc_id, succ_id, text, succ) -> digests of the text and the edited text, and what fingerprints are alike.

    Two fingerprints are alike if their digests are and, as equal buckets are compared byte by byte, their bytes are."""
    canons = both.select("doc_id", "succ_id", "text", _edited().alias("edited"), "succ", *more)
    canons = canons.select("doc_id", "succ_id", "text", "edited", canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("ce"), canonical(F.col("succ")).alias("cs"), *more)
    found = canons.select("*", digest(F.col("c")).alias("d"), digest(F.col("ce")).alias("e"), digest(F.col("cs")).alias("s"))
    alike = lambda a, b, x, y: F.when((F.col(a) == F.col(b)) & (F.col(x) == F.col(y)), 1.0).otherwise(0.0)
    return found.select("doc_id", "succ_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "d", "e", alike("d", "e", "c", "ce").alias("near_edited"), alike("d", "s", "c", "cs").alias("near_next"), F.xxhash64("text").alias("text_hash"), *more)


def _digests(docs: DataFrame) -> DataFrame:
    """The measures of each document with its successor, the document with the next larger id (at the end the smallest).

    Texts are dealt once, by id bucket. What crosses a bucket is its first and last document only; their texts are kept
    beside the measures, and the last are measured apart."""
    ids = docs.where("doc_id IS NOT NULL")
    alone = _measured(docs.where("doc_id IS NULL").withColumns({"succ_id": F.lit(None).cast("long"), "succ": F.lit("")}))
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return stored(alone)
    whole = None
    if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():  # repeated ids: one text stands for each
        whole, ids = ids, ids.groupBy("doc_id").agg(F.min("text").alias("text"))
    # Buckets are numbered from the lowest, so that all of them have one ancestor.
    bits = max(1, ((int(high) >> BUCKET_BITS) - (int(low) >> BUCKET_BITS)).bit_length())
    bucket = F.shiftright("doc_id", BUCKET_BITS) - F.lit(int(low) >> BUCKET_BITS)
    heads = stored(ids.groupBy(bucket.alias("b")).agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")))
    links = _next_heads(heads.select("b", "head"), bits).join(heads.select("b", "tail"), "b").select(F.col("tail").alias("doc_id"), F.coalesce("follow", F.lit(low).cast("long")).alias("succ_id"))
    links = stored(links)
    order = Window.partitionBy("b").orderBy("doc_id")
    step = ids.withColumn("b", bucket).select("doc_id", "text", F.lead("doc_id").over(order).alias("succ_id"), F.lead("text").over(order).alias("succ"), (F.lag("doc_id").over(order)).isNull().alias("first"))
    carry = F.when(F.col("first") | F.col("succ_id").isNull(), F.col("text")).alias("carry")
    if whole is None:
        rows = stored(_measured(step.select("doc_id", "text", "succ_id", F.coalesce("succ", F.lit("")).alias("succ"), carry), "carry").unionByName(alone.withColumn("carry", F.lit(None).cast("string"))))
        inner = rows.where("succ_id IS NOT NULL OR doc_id IS NULL").drop("carry")
    else:
        rows = stored(step.select("doc_id", "succ_id", "succ", carry))
    ends = rows.where("carry IS NOT NULL")
    first = ends.select(F.col("doc_id").alias("succ_id"), F.col("carry").alias("succ"))
    edge = ends.where("succ_id IS NULL").select("doc_id", F.col("carry").alias("text")).join(links, "doc_id").join(first, "succ_id")
    if whole is None:
        return stored(inner.unionByName(_measured(edge)))
    after = rows.where("succ_id IS NOT NULL").select("doc_id", "succ_id", "succ").unionByName(edge.select("doc_id", "succ_id", "succ"))
    return stored(_measured(whole.join(after, "doc_id")).unionByName(alone))


def _ranks(docs: DataFrame, rows: DataFrame, crowded: DataFrame) -> DataFrame | None:
    """Byte comparison inside equal buckets: (doc_id, text_hash, kind, rank) where different texts share a digest, else None.

    Texts are fetched for documents of shared buckets only; each task sends one smallest and one largest text a bucket."""
    used = rows.select("doc_id", "succ_id", "text_hash", F.explode(F.array(F.struct(F.lit("text").alias("kind"), F.col("d")), F.struct(F.lit("edit").alias("kind"), F.col("e").alias("d")))).alias("x")).select("doc_id", "succ_id", "text_hash", "x.*")
    used = stored(used.join(crowded, "d", "left_semi"))
    ids = stored(used.select(F.explode(F.expr("if(kind = 'edit', array(doc_id, succ_id), array(doc_id))")).alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    keyed = docs.withColumn("h", F.xxhash64("doc_id"))
    some = flagged(keyed, "h", ids.select(F.xxhash64("doc_id").alias("h"))).where("_maybe AND doc_id IS NOT NULL").select("doc_id", "text")
    texts = some.join(ids, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    succ = texts.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("succ_id")).agg(F.min("text").alias("succ"))
    own = texts.withColumn("text_hash", F.xxhash64("text"))
    at = used.alias("u").join(own.alias("o"), F.expr("u.doc_id <=> o.doc_id AND u.text_hash = o.text_hash")).select("u.*", "o.text")
    plain = at.where("kind = 'text'").select("d", "doc_id", "text_hash", "kind", F.col("text").alias("body"))
    edit = at.where("kind = 'edit'").join(succ, "succ_id", "left").withColumn("succ", F.coalesce("succ", F.lit(""))).select("d", "doc_id", "text_hash", "kind", _edited().alias("body"))
    bodies = plain.unionByName(edit).select("d", "doc_id", "text_hash", "kind", canonical(F.col("body")).alias("canon"))
    mixed = stored(bodies.groupBy("d").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("d"))
    if mixed.limit(1).count() == 0:
        return None
    bodies = bodies.join(mixed, "d", "left_semi")
    place = bodies.select("d", "canon").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy("canon")))
    return stored(bodies.join(place, ["d", "canon"]).select("doc_id", "text_hash", "kind", "rank").distinct())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The likeness of two exact fingerprints is 1 or 0."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = _digests(docs)
    crowded = stored(rows.select(F.explode(F.array("d", "e")).alias("d")).groupBy("d").count().where("count > 1").select("d"))
    ranks = _ranks(docs, rows, crowded)
    out = rows.withColumns({"fingerprint": _hex(F.col("d")), "edited_fingerprint": _hex(F.col("e"))})
    for kind, name in (("text", "fingerprint"), ("edit", "edited_fingerprint")) if ranks is not None else ():
        r = ranks.where(F.col("kind") == kind).select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "rank")
        out = out.join(r, F.expr("doc_id <=> r_id AND text_hash = r_hash"), "left").withColumn(name, F.concat(name, F.when(F.col("rank") > 1, F.concat(F.lit("-"), F.col("rank").cast("string"))).otherwise(""))).drop("r_id", "r_hash", "rank")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, group_id): the smallest id of the documents with the same canonical text."""
    prints = fingerprints(docs, id_col, text_col).select("doc_id", "fingerprint")
    return prints.join(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id")), "fingerprint").select("doc_id", "fingerprint", "group_id")
