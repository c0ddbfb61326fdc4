"""Row keys whose fallback is the digest of a JSON text, and small text parsers."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .records import bare_arxiv, bare_doi, source_label, text


@F.pandas_udf(StringType())
def _json_digest(title: pd.Series, year: pd.Series, doi: pd.Series, arxiv_id: pd.Series, url: pd.Series) -> pd.Series:
    """Digest of the JSON text with sorted keys, ASCII only; Spark's own JSON text is spaced and escaped otherwise."""
    rows = zip(title, year, doi, arxiv_id, url)
    return pd.Series([hashlib.sha1(json.dumps(dict(zip(("title", "year", "doi", "arxiv_id", "url"), r)), sort_keys=True).encode()).hexdigest()[:16] for r in rows])


def raw_row_key(source: Column, source_id: Column, title: Column, year: Column, doi: Column, arxiv_id: Column, url: Column) -> Column:
    """source:source_id, or the source and a digest of what else the row says."""
    s, i = source_label(source), F.trim(text(source_id))
    fallback = _json_digest(text(title), text(year), bare_doi(doi), bare_arxiv(arxiv_id), text(url))
    return F.when(i != "", F.concat(s, F.lit(":"), i)).otherwise(F.concat(s, F.lit(":fallback:"), fallback))


def section(c: Column) -> Column:
    """struct(id, title, text) of "id|title|text"; the text may hold further bars, missing parts are empty."""
    p = F.split(text(c), r"\|", 3)
    part = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)), F.lit(""))
    return F.struct(part(1).alias("id"), part(2).alias("title"), part(3).alias("text"))


def answers(c: Column) -> Column:
    """Map of "a=1,b=2"; items without "=" are left out, later ones win."""
    items = F.filter(F.split(text(c), ","), lambda x: x.contains("=") & (F.trim(F.substring_index(x, "=", 1)) != ""))
    entries = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^=]*=", "")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.when(F.trim(text(c)).rlike(r"^[+-]?[0-9]{1,9}$"), F.trim(c).cast("int")), F.lit(default))


def session_id(prompt: Column, at: Column) -> Column:
    """UTC stamp and the prompt's digest."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha1(text(prompt)), 1, 10))
