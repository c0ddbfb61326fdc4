"""Queries over connector payloads, made of the test tables as the services would send them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..sources import connectors as C
from .relations import CANDIDATES, REQUESTS, candidates, requests, s_arxiv, s_doi

c = F.col
VENUES = ["Journal of Municipal and Narrative Informatics", "Symposium on Seasonal and Neotropical Measurement"]
_SHOWN = ("source_id", "title", "venue", "year", "doi", "arxiv_id")


def _year(p):
    return F.nullif(R.digits_or_empty(c("year")), F.lit("")).cast("int")


def crossref_rows(spark, d):
    p = candidates(spark, d)
    y = _year(p)
    item = F.struct(c("doi").alias("DOI"), F.array(c("title")).alias("title"), F.array(c("venue")).alias("container-title"), F.when(y.isNotNull(), F.struct(F.array(F.array(y)).alias("date-parts"))).alias("issued"), c("url").alias("URL"))
    return C.crossref(p.select(F.to_json(item).alias("payload")), VENUES).groupBy(*_SHOWN).agg(F.count(F.lit(1)).alias("n"))


def openalex_rows(spark, d):
    p = candidates(spark, d)
    place = F.array(F.struct(F.when(c("arxiv_id") != "", F.concat(F.lit("https://arxiv.org/abs/"), R.bare_arxiv(c("arxiv_id")))).alias("landing_page_url")), F.struct(c("url").alias("landing_page_url")))
    item = F.struct(c("id"), c("title"), c("doi"), _year(p).alias("publication_year"), F.struct(F.struct(c("venue").alias("display_name")).alias("source")).alias("primary_location"), place.alias("locations"))
    return C.openalex(p.select(F.to_json(item).alias("payload")), any_address=False).select(*_SHOWN)


def semantic_rows(spark, d):
    p = candidates(spark, d)
    item = F.struct(c("id").alias("paperId"), c("title"), c("venue"), _year(p).alias("year"), F.struct(c("doi").alias("DOI"), c("arxiv_id").alias("ArXiv")).alias("externalIds"), c("url"))
    return C.semantic_scholar(p.select(F.to_json(item).alias("payload"))).select(*_SHOWN)


def searx_rows(spark, d):
    """Result pages of twenty rows each, ten kept of a page before years are looked at."""
    q = requests(spark, d)
    item = F.struct("qid", c("title"), c("url"), F.struct(c("doi").alias("doi"), c("venue").alias("journal"), _year(q).alias("year")).alias("metadata"))
    pages = q.groupBy(F.floor(c("qid") / 20).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("results"))
    pages = pages.select(F.to_json(F.struct("results")).alias("payload"))
    return C.searx(pages, 10, (2015, 2024)).select("title", "venue", "year", "doi", "url")


QUERIES = {"q_crossref_rows": crossref_rows, "q_openalex_rows": openalex_rows, "q_semantic_rows": semantic_rows, "q_searx_rows": searx_rows}

_Y = "CASE WHEN regexp_matches(trim(year, ' '), '^[0-9]+$') THEN trim(year, ' ') ELSE '0' END"
_IN = ", ".join(f"'{v.lower()}'" for v in VENUES)
SQL = {
    "q_crossref_rows": f"SELECT {s_doi('doi')} AS source_id, title, venue, {_Y} AS year, {s_doi('doi')} AS doi, '' AS arxiv_id, count(*) AS n FROM ({CANDIDATES}) WHERE venue = '' OR lower(venue) IN ({_IN}) GROUP BY ALL",
    "q_openalex_rows": f"SELECT id AS source_id, title, venue, {_Y} AS year, {s_doi('doi')} AS doi, CASE WHEN arxiv_id <> '' THEN {s_arxiv(chr(39) + 'https://arxiv.org/abs/' + chr(39) + ' || ' + s_arxiv('arxiv_id'))} ELSE '' END AS arxiv_id FROM ({CANDIDATES})",
    "q_semantic_rows": f"SELECT id AS source_id, title, venue, {_Y} AS year, {s_doi('doi')} AS doi, {s_arxiv('arxiv_id')} AS arxiv_id FROM ({CANDIDATES})",
    "q_searx_rows": f"""WITH q AS (SELECT *, {_Y} AS y, row_number() OVER (PARTITION BY qid // 20 ORDER BY qid) AS n FROM ({REQUESTS}))
SELECT title, venue, CASE WHEN y = '0' AND trim(year, ' ') <> '0' THEN '' ELSE CAST(CAST(y AS INT) AS VARCHAR) END AS year, {s_doi('doi')} AS doi, url FROM q WHERE n <= 10 AND (y = '0' AND trim(year, ' ') <> '0' OR CAST(y AS INT) BETWEEN 2015 AND 2024)""",
}
