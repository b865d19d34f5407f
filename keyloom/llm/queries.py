"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import quality, toxicity, warc
from .common import scratch_path, table
from .decontaminate import report
from .fingerprint import fingerprints
from .packing import pack
from .pii import find
from .shuffle import shards
from .simhash import simhash_components
from .substrings import report as substring_report


def op1_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprint(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op3_substrings(spark, sf_dir):
    return substring_report(table(spark, sf_dir, "documents"))


def op4_merkle_fixity(spark, sf_dir):
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write(warc.damaged(pages), path)  # a replica as stored, with known faults
    return warc.report(warc.leaves(pages), warc.read(spark, path))


def op5_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_external_shuffle(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
kept AS (SELECT x.doc_id, string_agg(x.w, ' ' ORDER BY x.p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d) AS x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body,
           page_id % 97 = 5 AND length(html) > 0 AND html[1] <> '#' AS damaged FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT page_id, damaged, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || regexp_replace(md5(page_id || ' ' || url), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'Content-Type: application/http;msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM p)
SELECT page_id, page_id // 256 AS file, row_number() OVER w - 1 AS place, CAST(sum(strlen(r)) OVER w - strlen(r) AS BIGINT) AS start, strlen(r) AS size,
       sha256('\x00'::BLOB || encode(r)) AS digest, NOT damaged AS intact
FROM r WINDOW w AS (PARTITION BY page_id // 256 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(8, len(w)) AS n FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dg.doc_id, dg.n, dg.i, bg.item FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(items.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def oracle_sql():
    return {"op3_substrings": OP3_SQL, "op4_merkle_fixity": OP4_SQL, "op10_decontaminate": OP10_SQL}
