"""Cleaning item text and building sentences from catalogue fields."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The character references that built-in unescaping covers; others go through the
# Python fallback ``unescape``.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&reg;": "®"}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape_common(c) -> Column:
    """HTML unescape of ENTITIES inside the JVM; the ampersand comes last so nothing is decoded twice."""
    out = col(c)
    for ref, char in ENTITIES.items():
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


def unescape(c) -> Column:
    """Full HTML unescape in Arrow batches, for references that ENTITIES lacks."""
    return _unescape(col(c))


def clean_text(c, full: bool = False) -> Column:
    """Unescape, trim, drop tags, newlines and tabs to blanks, blank runs to one, then every character
    outside ASCII to a blank (so runs of blanks can come back). A list is joined with ', ' by the caller."""
    out = F.regexp_replace((unescape if full else unescape_common)(c), r"^\s+|\s+$", "")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = F.regexp_replace(out, r"[\n\t]", " ")
    out = F.regexp_replace(out, " +", " ")
    return F.regexp_replace(out, r"[^\x00-\x7F]", " ")


def present(c) -> Column:
    c = col(c)
    return c.isNotNull() & (c != "")


def field_sentence(c, kind: str) -> Column:
    """One field as a sentence that ends with a blank; empty where the field is absent.

    kind: ``text`` (cleaned), ``number`` (its text and a full stop), ``list`` (array of arrays: each
    cleaned value loses its last character, values are joined with ', ' and end with a full stop)."""
    c = col(c)
    if kind == "number":
        return F.when(c.isNotNull(), F.concat(c.cast("string"), F.lit(". "))).otherwise("")
    if kind == "text":
        return F.when(present(c), F.concat(clean_text(c), F.lit(" "))).otherwise("")
    values = F.transform(F.flatten(c), lambda v: clean_text(v))
    cut = F.transform(values, lambda v: F.substring(v, 1, F.length(v) - 1))
    return F.when(F.size(c) > 0, F.concat(F.array_join(cut, ", "), F.lit(". "))).otherwise("")


def item_sentence(fields: list[tuple[str, str]]) -> Column:
    """Fields (name, kind) in the given order, those that are absent left out."""
    return F.concat(*[field_sentence(name, kind) for name, kind in fields])


def structured_text(fields: list[tuple[str, str]]) -> Column:
    """Lines of 'Label: value' for the fields (column, label) that are present."""
    return F.concat_ws("\n", *[F.when(present(F.col(c).cast("string")), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for c, label in fields])


def bilingual_text(zh, en, mode: str = "both") -> Column:
    """Chinese, English or both; a missing one falls back to the other."""
    zh, en = F.nullif(F.trim(col(zh)), F.lit("")), F.nullif(F.trim(col(en)), F.lit(""))
    if mode == "zh":
        return F.coalesce(zh, en, F.lit(""))
    if mode == "en":
        return F.coalesce(en, zh, F.lit(""))
    if mode != "both":
        raise ValueError("mode is zh, en or both")
    return F.when(zh.isNotNull() & en.isNotNull(), F.concat(F.lit("Chinese: "), zh, F.lit("\nEnglish: "), en)).otherwise(F.coalesce(zh, en, F.lit("")))


def first_url(*cols) -> Column:
    """The first usable address among columns of string or array of string."""
    found = []
    for c, kind in cols:
        c = col(c)
        if kind == "array":
            c = F.get(F.filter(c, lambda x: F.trim(x) != ""), 0)
        found.append(F.nullif(F.trim(c), F.lit("")))
    return F.coalesce(*found)


def safe_name(c, most: int = 120) -> Column:
    """A file-safe name; one that is too long keeps a prefix and a short digest."""
    name = F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "-")
    short = F.concat(F.substring(name, 1, most - 13), F.lit("-"), F.substring(F.sha2(name, 256), 1, 12))
    return F.when(F.length(name) <= most, name).otherwise(short)


def identity(*cols) -> Column:
    """A short digest of a configuration, for names of artefacts."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 12)


def percent(c, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c) * 100)


def _flat(value) -> str:
    """Values of any nesting of lists and dicts, depth first, those that are not empty parted by blanks."""
    if value is None:
        return ""
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return " ".join(x for x in map(_flat, value) if x)
    return str(value).strip()


@F.pandas_udf(T.StringType())
def _flattened(s: pd.Series) -> pd.Series:
    def one(x):
        if not isinstance(x, str):
            return ""
        try:
            return _flat(json.loads(x))
        except ValueError:
            return x.strip()

    return s.map(one)


def flattened(c) -> Column:
    """A field of any nesting, as JSON text (structs, arrays and maps through to_json), as plain text; text that is no
    JSON is itself."""
    return _flattened(col(c))
