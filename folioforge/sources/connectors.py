"""Flattening of connector payloads (one JSON text a row) into candidate rows.

Every function takes a DataFrame with a string column ``payload`` and gives the
columns of ROW; venues asked for are compared without regard to case, and rows
without a venue pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R

ROW = ("source", "source_id", "title", "venue", "year", "doi", "arxiv_id", "url", "score")
CROSSREF = "DOI string, title array<string>, `container-title` array<string>, issued struct<`date-parts`: array<array<int>>>, URL string"
OPENALEX = "id string, title string, doi string, publication_year int, primary_location struct<source: struct<display_name: string>>, locations array<struct<landing_page_url: string>>"
SEMANTIC = "paperId string, title string, venue string, year int, externalIds struct<DOI: string, ArXiv: string>, url string"
SEARX = "results array<struct<title: string, url: string, metadata: struct<doi: string, journal: string, year: int>>>"

c = F.col


def first(a: Column) -> Column:
    return R.text(F.try_element_at(a, F.lit(1)))


def _row(df: DataFrame, source: str, score: float, **fields: Column) -> DataFrame:
    full = {"source": F.lit(source), "score": F.lit(score)} | fields
    return df.select(*[full[k].alias(k) for k in ROW])


def in_venues(rows: DataFrame, venues: list[str]) -> DataFrame:
    if not venues:
        return rows
    return rows.where((c("venue") == "") | F.lower("venue").isin([v.lower() for v in venues]))


def crossref(payloads: DataFrame, venues: list[str] = (), score: float = 1.0) -> DataFrame:
    x = payloads.select(F.from_json("payload", CROSSREF).alias("p")).where("p is not null")
    year = F.coalesce(F.try_element_at(F.try_element_at(c("p.issued.date-parts"), F.lit(1)), F.lit(1)), F.lit(0))
    rows = _row(x, "crossref", score, source_id=R.bare_doi(c("p.DOI")), title=first(c("p.title")), venue=first(c("p.container-title")), year=year.cast("string"), doi=R.bare_doi(c("p.DOI")), arxiv_id=F.lit(""), url=R.text(c("p.URL")))
    return in_venues(rows, list(venues))


def openalex(payloads: DataFrame, venues: list[str] = (), score: float = 1.0, any_address: bool = True) -> DataFrame:
    """The arXiv id is that of the first location with one; with ``any_address`` any address counts as one, as upstream rows do."""
    x = payloads.select(F.from_json("payload", OPENALEX).alias("p")).where("p is not null")
    ids = F.transform(F.coalesce(c("p.locations"), F.array().cast("array<struct<landing_page_url:string>>")), lambda a: R.text(a["landing_page_url"]))
    kept = F.filter(ids, lambda u: (R.bare_arxiv(u) != "") & (F.lit(any_address) | u.contains("arxiv.org/")))
    rows = _row(x, "openalex", score, source_id=R.text(c("p.id")), title=R.text(c("p.title")), venue=R.text(c("p.primary_location.source.display_name")), year=F.coalesce(c("p.publication_year"), F.lit(0)).cast("string"), doi=R.bare_doi(c("p.doi")), arxiv_id=R.bare_arxiv(first(kept)), url=first(ids))
    return in_venues(rows, list(venues))


def semantic_scholar(payloads: DataFrame, venues: list[str] = (), score: float = 1.0) -> DataFrame:
    x = payloads.select(F.from_json("payload", SEMANTIC).alias("p")).where("p is not null")
    rows = _row(x, "semantic_scholar", score, source_id=R.text(c("p.paperId")), title=R.text(c("p.title")), venue=R.text(c("p.venue")), year=F.coalesce(c("p.year"), F.lit(0)).cast("string"), doi=R.bare_doi(c("p.externalIds.DOI")), arxiv_id=R.bare_arxiv(c("p.externalIds.ArXiv")), url=R.text(c("p.url")))
    return in_venues(rows, list(venues))


def searx(payloads: DataFrame, limit: int, years: tuple[int, int] | None = None, score: float = 0.25) -> DataFrame:
    """The first ``limit`` results of each payload, those of known years outside ``years`` left out afterwards."""
    x = payloads.select(F.explode(F.slice(F.from_json("payload", SEARX)["results"], 1, limit)).alias("p"))
    year = c("p.metadata.year")
    if years:
        x = x.where(year.isNull() | year.between(*years))
    own = R.bare_arxiv(F.when(c("p.url").contains("arxiv.org/"), c("p.url")))
    return _row(x, "searxng", score, source_id=R.text(c("p.url")), title=R.text(c("p.title")), venue=R.text(c("p.metadata.journal")), year=R.text(year.cast("string")), doi=R.bare_doi(c("p.metadata.doi")), arxiv_id=own, url=R.text(c("p.url")))
