"""What the two classifiers share: the split by id, a bounded training sample, features of texts, scoring.

The sample has at most `per_class` labelled rows of each class, those with the smallest hashes of their ids; it is the
only part of the corpus that a model is fitted on, and whole texts are used. Everything else runs over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_of


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, y) for at most 2 * per_class labelled ids that aren't held out. Contradicting labels of an id count
    as 0; of several texts under one id the smallest counts, so that the sample keeps its bound."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(remainder(modulus) != held)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def collect_features(sample: DataFrame, features: Callable[[list[bytes]], list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct feature numbers and their counts for each sampled text, ordered by content; bounded by the sample."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            for low, high in cut(texts):
                found = [np.unique(x, return_counts=True) for x in features(texts[low:high])]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([b.astype("<i4").tobytes() for _, b in found], pa.binary())], ["doc_id", "y", "f", "n"])

    rows = sorted(sample.mapInArrow(run, "doc_id long, y int, f binary, n binary").collect(), key=lambda r: (r.doc_id, bytes(r.f)))
    return [np.frombuffer(r.f, "<i4") for r in rows], [np.frombuffer(r.n, "<i4") for r in rows], np.array([r.y for r in rows], np.int64)


def score(docs: DataFrame, model, logits: Callable, modulus: int, held: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; `logits(model, texts)` gives a number for each text."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            for low, high in cut(texts):
                values = np.asarray(logits(bound.value, texts[low:high]), float)
                scores = 1 / (1 + np.exp(-np.clip(values, -30, 30)))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["_row", "score", "predicted"])

    names = docs.columns
    held_rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col("text").cast("string").alias("text"))
    out = held_rows.mapInArrow(run, f"_row {docs.schema.simpleString()}, score double, predicted int")
    return out.select("_row", F.coalesce(remainder(modulus, "_row.doc_id") == held, F.lit(False)).alias("held_out"), "score", "predicted")
