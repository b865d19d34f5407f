"""The text and JSON analysers: values become weighted postings (key, kind, field, token, score).

A text is cut into sentences at . ; * and, outside a labelled list, at commas; a dot between digits belongs to a number.
`label: words` or `label = words` names the field of its sentence. A token is a quoted phrase, a number, or a run of
characters that are neither blank, operator nor bracket; a token weighs one over the tokens of its sentence. Tokens and
fields are in ASCII upper case. A posting scores the sum of its weights over the square of its count, or the plain sum.

Each level (sentences, lists, tokens) is a row of its own, so that every expression is worked out once and in generated
code. Only JSON, which nests to any depth, is taken apart in Python, in Arrow batches of the values that begin like it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expr import _LOWER, _UPPER, upper

#: Bytes of values that a task tallies, so that its groups stay in memory.
PART_BYTES = 8 << 20
_BLANK = r" \t\n\r\f\x0B"
_SPECIAL = r"""\[\](){};:<=>!+^/\\?|&%,*.\-"`"""
TOKEN = rf'"[^"]*"|[0-9]+(?:\x01[0-9]+)?|[^{_BLANK}{_SPECIAL}0-9][^{_BLANK}{_SPECIAL}]*'
LABEL = rf"^[{_BLANK}]*([A-Za-z0-9_]+)[{_BLANK}]*[:=](?:[^\"`“”]{{8}}|[^\"`“”]{{0,7}}$)"
_PREFIX = rf"^[{_BLANK}]*[A-Za-z0-9_]+[{_BLANK}]*[:=]"


def json_values(field: str, text: str) -> list[dict]:
    """(field, value) of all that is said in a JSON text; a field is the name of the innermost object key. No JSON, no
    values. A null says nothing."""
    try:
        found = json.loads(text, parse_int=str, parse_float=str, parse_constant=str)
    except ValueError:
        return []
    out, rest = [], [(field, found)]
    while rest:
        name, value = rest.pop()
        if isinstance(value, dict):
            rest += [(k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            rest += [(name, v) for v in reversed(value)]
        elif value is not None:
            out.append({"field": name, "value": value if isinstance(value, str) else json.dumps(value)})
    return out


def json_fields(rows: DataFrame) -> DataFrame:
    """(.., field, value) with JSON objects and arrays taken apart, however deep they are."""

    @F.pandas_udf("array<struct<field: string, value: string>>")
    def apart(field: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([json_values(f, v) for f, v in zip(field, value)], dtype=object)

    keep = [c for c in rows.columns if c not in ("field", "value")]
    return rows.select(*keep, F.explode(apart("field", "value")).alias("_e")).select(*keep, "_e.field", "_e.value")


def fields(documents: DataFrame) -> DataFrame:
    """(key, kind, field, value) of all that is indexed: a text under *, each property, JSON under its own names."""
    text = documents.where("text IS NOT NULL").select("key", "kind", F.lit("*").alias("field"), F.col("text").alias("value"))
    props = documents.where("props IS NOT NULL").select("key", "kind", F.explode("props").alias("field", "value")).where("value IS NOT NULL")
    rows = text.unionByName(props)
    is_json = F.ltrim("value").startswith("{")
    return rows.where(~is_json).unionByName(json_fields(rows.where(is_json)))


def parts_of(documents: DataFrame) -> int:
    """Tasks to deal documents to, by what they hold: at most PART_BYTES on average, and all cores where there is enough."""
    said = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.aggregate(F.map_values("props"), F.lit(0), lambda n, v: n + F.coalesce(F.octet_length(v), F.lit(0))), F.lit(0))
    total = documents.agg(F.sum(said.cast("long"))).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return max(1 + total // PART_BYTES, min(cores, 1 + total // (PART_BYTES // 8)))


def tokens(rows: DataFrame) -> DataFrame:
    """(key, kind, field, token, w) for each place of a token."""
    whole = F.regexp_replace("value", r"([0-9])\.([0-9])", "$1\u0001$2")
    said = rows.select("key", "kind", "field", F.explode(F.split(whole, r"[.;*]")).alias("s"))
    label = F.when(F.contains("s", F.lit(":")) | F.contains("s", F.lit("=")), F.regexp_extract("s", LABEL, 1)).otherwise("")
    said = said.select("key", "kind", "field", "s", label.alias("label"))
    part = F.explode(F.when(F.col("label") != "", F.array(F.regexp_replace("s", _PREFIX, ""))).otherwise(F.split("s", ",")))
    said = said.select("key", "kind", F.when(F.col("label") != "", F.col("label")).otherwise(F.col("field")).alias("field"), part.alias("s"))
    said = said.select("key", "kind", upper(F.col("field")).alias("field"), F.array_remove(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0)), '""').alias("t"))
    each = said.select("key", "kind", "field", (1 / F.greatest(F.size("t"), F.lit(1))).alias("w"), F.explode("t").alias("token"))
    clean = F.translate("token", "\u0001" + _LOWER + '"', "." + _UPPER)  # quotes go
    return each.select("key", "kind", "field", clean.alias("token"), "w")


def tally(rows: DataFrame, parts: int) -> DataFrame:
    """(key, kind, field, token, weight, n). Values are dealt out by key before they are cut up, so that only texts are
    shuffled and never their many tokens, and a key's upkeep stays in one place."""
    each = tokens(rows.repartition(parts, "key"))
    return each.groupBy("key", "kind", "field", "token").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))


def token_tally(rows: DataFrame) -> DataFrame:
    """(field, token, weight, n) over all keys: tokens are summed up where they are found, without their keys."""
    return tokens(rows).groupBy("field", "token").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))


def postings(documents: DataFrame, scoring: str = "weighted") -> DataFrame:
    score = F.col("weight") / (F.col("n") * F.col("n")) if scoring == "weighted" else F.col("weight")
    return tally(fields(documents), parts_of(documents)).select("key", "kind", "field", "token", score.alias("score"))
