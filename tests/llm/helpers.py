"""Small awkward tables and brute-force versions."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """rows: (doc_id, text); extra adds columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.selectExpr("*", "1 AS d", "'x' AS fp", "2 AS _row", "'k' AS key", "3.0 AS score", "'b' AS base", "0 AS _bucket_", "4 AS length", "5 AS _bucket", "6 AS _place", "7 AS _gone", "8 AS _nth", "9 AS bucket", "10 AS place", "11 AS h", "12 AS node", "13 AS _maybe", "14 AS size") if extra else df


def awkward():
    """Nulls, empty and blank texts, repeats of rows and texts, a very long text, letters of many kinds."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta.", "éa", "ß", "日本", "x1"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    base = " ".join(rng.choice(words) for _ in range(60))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base), (5, base), (6, base + " tail"), (7, long), (None, base), (None, None), (300, "one"), (9000, base.upper()), (-4, "a b c d e f g h"), (11, "x")]
