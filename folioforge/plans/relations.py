"""Relations that the queries share, in Spark and as SQL for the cross-check.

``candidates`` are the rows of papers as sources deliver them (missing values
empty, lists as arrays, ``ord`` the order of arrival); ``requests`` are the
rows of discovery_rows as lookups; ``prompts`` are search prompts made of
their titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "papers")
    terms = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    number = F.substring("id", 4, 20).cast("long")
    return p.select(
        "id", number.alias("ord"), *[R.text(F.col(c)).alias(c) for c in ("source", "source_id", "title", "venue")],
        R.text(F.col("year").cast("string")).alias("year"), *[R.text(F.col(c)).alias(c) for c in ("doi", "arxiv_id")],
        R.text(F.col("html_url")).alias("url"), R.text(F.col("abstract")).alias("abstract"),
        terms("keywords_json").alias("keywords"), terms("categories_json").alias("categories"), ((number % 20) / 20.0).alias("score"),
    )


CANDIDATES = """
SELECT id, CAST(substr(id, 4) AS BIGINT) AS ord, coalesce(source, '') AS source, coalesce(source_id, '') AS source_id, coalesce(title, '') AS title,
  coalesce(venue, '') AS venue, coalesce(CAST(year AS VARCHAR), '') AS year, coalesce(doi, '') AS doi, coalesce(arxiv_id, '') AS arxiv_id,
  coalesce(html_url, '') AS url, coalesce(abstract, '') AS abstract,
  coalesce(from_json(keywords_json, '["VARCHAR"]'), []) AS keywords, coalesce(from_json(categories_json, '["VARCHAR"]'), []) AS categories,
  (CAST(substr(id, 4) AS BIGINT) % 20) / 20.0 AS score
FROM papers"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "discovery_rows")
    return d.select(F.col("row_id").alias("qid"), *[R.text(F.col(c)).alias(c) for c in ("source", "source_id", "title", "venue", "year", "doi", "arxiv_id", "url")], F.when(F.col("url").contains("arxiv.org/"), F.col("url")).otherwise("").alias("arxiv_url"))


REQUESTS = """
SELECT row_id AS qid, coalesce(source, '') AS source, coalesce(source_id, '') AS source_id, coalesce(title, '') AS title, coalesce(venue, '') AS venue,
  coalesce(year, '') AS year, coalesce(doi, '') AS doi, coalesce(arxiv_id, '') AS arxiv_id, coalesce(url, '') AS url, CASE WHEN contains(url, 'arxiv.org/') THEN url ELSE '' END AS arxiv_url
FROM discovery_rows"""

_SHAPES = ("latest papers on {t} from top AI conferences", "{t} cited by related work", "dblp {t} proceedings", "find details for {i}", 'papers on "{t}"', "{t} recent survey", "show me {t} and related work")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = requests(spark, sf_dir)
    ident = F.when(F.col("doi") != "", F.col("doi")).when(F.col("arxiv_id") != "", F.col("arxiv_id")).otherwise(F.col("title"))
    out = F.lit("")
    for k, shape in enumerate(_SHAPES):
        before, _, after = shape.partition("{t}") if "{t}" in shape else shape.partition("{i}")
        out = F.when(F.col("qid") % len(_SHAPES) == k, F.concat(F.lit(before), F.col("title") if "{t}" in shape else ident, F.lit(after))).otherwise(out)
    return q.select("qid", out.alias("prompt"))


def _prompt_sql() -> str:
    ident = "CASE WHEN doi <> '' THEN doi WHEN arxiv_id <> '' THEN arxiv_id ELSE title END"
    arms = []
    for k, shape in enumerate(_SHAPES):
        before, _, after = shape.partition("{t}") if "{t}" in shape else shape.partition("{i}")
        arms.append(f"WHEN qid % {len(_SHAPES)} = {k} THEN concat('{before}', {'title' if '{t}' in shape else ident}, '{after}')")
    return f"SELECT qid, CASE {' '.join(arms)} ELSE '' END AS prompt FROM ({REQUESTS})"


PROMPTS = _prompt_sql()

# SQL twins of the column builders in functions.records


def s_doi(c: str) -> str:
    v = f"lower(trim(coalesce({c}, ''), ' '))"
    return f"(CASE WHEN starts_with({v}, 'https://doi.org/') THEN substr({v}, 17) WHEN starts_with({v}, 'http://doi.org/') THEN substr({v}, 16) WHEN starts_with({v}, 'doi:') THEN substr({v}, 5) ELSE {v} END)"


def s_arxiv(c: str) -> str:
    v = rf"regexp_replace(lower(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')), '^arxiv:', '')"
    path = rf"regexp_replace(regexp_replace(regexp_replace({v}, '^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*', ''), '[?#].*$', ''), '^/(?:abs|pdf)/|^/+', '')"
    plain = rf"regexp_replace({v}, '[?#].*$', '')"
    return rf"regexp_replace(regexp_replace(CASE WHEN contains({v}, 'arxiv.org/') THEN {path} ELSE {plain} END, '\.pdf$', ''), 'v[0-9]+$', '')"


def s_title(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"


def s_alias(c: str) -> str:
    d = s_doi(c)
    return f"(CASE WHEN starts_with({d}, '10.48550/arxiv.') THEN {s_arxiv(f'substr({d}, 16)')} ELSE '' END)"


def s_paper_id(doi: str, arxiv: str, title: str, year: str) -> str:
    return f"(CASE WHEN {doi} <> '' THEN concat('doi:', {doi}) WHEN {arxiv} <> '' THEN concat('arxiv:', {arxiv}) ELSE concat('title:', {s_title(title)}, ':', {year}) END)"


def s_dedup() -> str:
    return s_paper_id(s_doi("doi"), s_arxiv("arxiv_id"), "title", "year")


def s_clean(c: str) -> str:
    v = f"coalesce({c}, '')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        v = f"replace({v}, '{name}', '{char}')"
    return rf"trim(regexp_replace(regexp_replace({v}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


def s_shorten(c: str, n: int, mark: str) -> str:
    return rf"(CASE WHEN length({c}) <= {n} THEN {c} ELSE concat(regexp_replace(substr({c}, 1, {n - len(mark)}), '\s+$', ''), '{mark}') END)"
