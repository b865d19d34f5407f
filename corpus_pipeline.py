"""The corpus pipeline: documents go through five stages, each written as Parquet and read again by the next.

quality      documents that the classifier rejects go
near_dedup   one document of each group of near-duplicates stays (fingerprints at 4 or fewer bits, as operator 8 joins
             them, or five-word shingles with a similarity of 0.8 or more)
decontaminate  documents with two or more test items go; hit spans are cut out of the others
pii          personal data and disclosing terms are rewritten
packing      pieces of at most 2048 tokens with their places in sequences

All but the last return the columns of documents. Empty tables, nulls and repeated rows are defined by each operator.
SQL can express neither the classifier nor the tokeniser, so there is no oracle; tests compare with brute force.
"""

from __future__ import annotations

from keyloom.llm import decontaminate as _decontaminate
from keyloom.llm import packing as _packing
from keyloom.llm import pii as _pii
from keyloom.llm import quality as _quality
from keyloom.llm import simhash as _simhash
from keyloom.llm.common import small_batches, stored, table

ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    return _quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    small_batches(spark)
    return _simhash.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    return _decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark, docs, sf_dir):
    small_batches(spark)
    return _pii.sanitise(docs)


def packing(spark, docs, sf_dir):
    import public_tokenizers

    small_batches(spark)
    return _packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("packing", packing)]


def run(spark, sf_dir):
    """The packed pieces of sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
