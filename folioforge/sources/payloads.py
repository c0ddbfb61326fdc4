"""Payloads of scholarly services as full records: nested authors with affiliations, subjects, and a score by how they were asked.

Every function takes a DataFrame with a string column ``payload`` (one JSON text a row) and gives the
columns of RECORD.  ``reason`` says how the service was asked; each service scores its answers by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from .connectors import first

AUTHORS = "array<struct<name: string, orcid: string, source_id: string, affiliations: array<struct<name: string, ror: string, country: string>>>>"
RECORD = ("source", "source_id", "title", "venue", "year", "doi", "arxiv_id", "url", "abstract", "keywords", "categories", "authors", "score", "reason")
# Scores of a service's answers by the way it was asked.
SCORES = {
    "crossref": {"lookup_doi": 1.0, "open_query": 0.4}, "arxiv": {"lookup_arxiv": 1.0, "search_title": 0.6},
    "openalex": {"lookup_doi": 1.0, "lookup_arxiv": 0.9, "search_title": 0.7}, "semantic_scholar": {"lookup_doi": 1.0, "lookup_arxiv": 0.95, "search_title": 0.75},
}
CROSSREF = """DOI string, title array<string>, `container-title` array<string>, issued struct<`date-parts`: array<array<int>>>, URL string, abstract string, subject array<string>,
author array<struct<given: string, family: string, ORCID: string, affiliation: array<struct<name: string>>>>"""
ARXIV = "entry_id string, title string, published string, summary string, categories array<string>, authors array<struct<name: string>>"
OPENALEX = """id string, title string, doi string, publication_year int, ids struct<arxiv: string>, abstract_inverted_index map<string, array<int>>, concepts array<struct<display_name: string>>,
primary_location struct<landing_page_url: string, source: struct<display_name: string>>,
primary_topic struct<subfield: struct<display_name: string>, field: struct<display_name: string>, domain: struct<display_name: string>>,
authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, institutions: array<struct<display_name: string, ror: string, country_code: string>>>>"""
#: The fields that say who wrote a work.
OPENALEX_BYLINES = "id string, " + OPENALEX[OPENALEX.index("authorships "):]
SEMANTIC = """paperId string, title string, venue string, year int, externalIds struct<DOI: string, ArXiv: string>, url string, abstract string, fieldsOfStudy array<string>,
s2FieldsOfStudy array<struct<category: string>>, authors array<struct<authorId: string, name: string, externalIds: struct<ORCID: string>, affiliations: array<string>>>"""

c = F.col


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def affiliation(name: Column, ror: Column | None = None, country: Column | None = None) -> Column:
    part = lambda x: F.trim(R.text(x)) if x is not None else F.lit("")
    return F.struct(part(name).alias("name"), part(ror).alias("ror"), part(country).alias("country"))


def author(name: Column, orcid: Column | None, source_id: Column | None, affiliations: Column) -> Column:
    """An author in normal form: a bare ORCID, and no affiliations of which nothing is known."""
    bare = F.regexp_replace(F.lower(F.trim(R.text(orcid))), r"^(?:https?://orcid\.org/|orcid:)", "") if orcid is not None else F.lit("")
    known = F.filter(affiliations, lambda a: (a["name"] != "") | (a["ror"] != "") | (a["country"] != ""))
    return F.struct(F.trim(R.text(name)).alias("name"), bare.alias("orcid"), F.trim(R.text(source_id)).alias("source_id") if source_id is not None else F.lit("").alias("source_id"), known.alias("affiliations"))


def record(df: DataFrame, source: str, reason: str, **fields: Column) -> DataFrame:
    """Rows in normal form of what a service calls its fields; fields that it lacks are empty."""
    trimmed = {k: F.trim(R.text(fields[k])) if k in fields else F.lit("") for k in ("source_id", "title", "venue", "year", "url")}
    out = trimmed | {
        "source": F.lit(source), "doi": R.bare_doi(fields.get("doi", F.lit(""))), "arxiv_id": R.bare_arxiv(fields.get("arxiv_id", F.lit(""))), "abstract": R.clean(fields.get("abstract", F.lit(""))),
        "keywords": R.distinct_terms(F.coalesce(fields["keywords"], _none("array<string>"))), "categories": R.distinct_terms(F.coalesce(fields["categories"], _none("array<string>"))),
        "authors": F.coalesce(fields["authors"], _none(AUTHORS)).cast(AUTHORS), "score": F.lit(SCORES[source][reason]), "reason": F.lit(reason),
    }
    return df.select(*[out[k].alias(k) for k in RECORD])


def _parsed(payloads: DataFrame, shape: str) -> DataFrame:
    # a filter on a generator's column stays above it; on a projection's it would go below, with texts and all they are made of worked out again
    return payloads.select(F.explode(F.array(F.from_json("payload", shape))).alias("p")).where("p is not null")


def crossref(payloads: DataFrame, reason: str = "lookup_doi") -> DataFrame:
    """Only a lookup brings authors; of a list of titles or venues the first counts."""
    year = F.try_element_at(F.try_element_at(c("p.issued.date-parts"), F.lit(1)), F.lit(1)).cast("string")
    people = F.transform("p.author", lambda a: author(
        F.concat(F.trim(R.text(a["given"])), F.lit(" "), F.trim(R.text(a["family"]))), a["ORCID"], None, F.transform(F.coalesce(a["affiliation"], _none("array<struct<name: string>>")), lambda x: affiliation(x["name"]))))
    return record(
        _parsed(payloads, CROSSREF), "crossref", reason, source_id=c("p.DOI"), title=first(c("p.title")), venue=first(c("p.container-title")), year=year, doi=c("p.DOI"), url=c("p.URL"),
        abstract=c("p.abstract"), keywords=c("p.subject"), categories=c("p.subject"), authors=people if reason == "lookup_doi" else _none(AUTHORS))


def arxiv(payloads: DataFrame, reason: str = "lookup_arxiv") -> DataFrame:
    """The year is that of publication; categories are the keywords too; only a lookup brings authors."""
    people = F.transform("p.authors", lambda a: author(a["name"], None, None, _none("array<struct<name: string, ror: string, country: string>>")))
    return record(
        _parsed(payloads, ARXIV), "arxiv", reason, source_id=R.bare_arxiv(c("p.entry_id")), title=c("p.title"), venue=F.lit("arXiv"), year=F.regexp_extract(R.text(c("p.published")), r"^([0-9]{4})", 1),
        arxiv_id=c("p.entry_id"), url=c("p.entry_id"), abstract=c("p.summary"), keywords=c("p.categories"), categories=c("p.categories"), authors=people if reason == "lookup_arxiv" else _none(AUTHORS))


def _openalex_author(a: Column) -> Column:
    none = _none("array<struct<display_name: string, ror: string, country_code: string>>")
    places = F.transform(F.coalesce(a["institutions"], none), lambda i: affiliation(i["display_name"], i["ror"], i["country_code"]))
    return author(a["author"]["display_name"], a["author"]["orcid"], a["author"]["id"], places)


def openalex_bylines(payloads: DataFrame) -> DataFrame:
    """source_id, place, author: a row for each author of each work, as in the records' ``authors``.

    Of the payload only these fields are kept, and authors are rows before they are put in normal form: in a list
    that is exploded, all of them would be worked out once more to see whether the list is empty.
    """
    each = _parsed(payloads, OPENALEX_BYLINES).select(F.trim(R.text(c("p.id"))).alias("source_id"), F.posexplode("p.authorships").alias("place", "a"))
    return each.select("source_id", "place", _openalex_author(c("a")).alias("author"))


def openalex(payloads: DataFrame, reason: str = "lookup_doi") -> DataFrame:
    """Concepts are keywords; subfield, field and domain of the topic are categories; abstracts come as token positions."""
    at = F.flatten(F.transform(F.map_entries("p.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("at"), e["key"].alias("token")))))
    topic = F.array(*[R.text(c(f"p.primary_topic.{k}.display_name")) for k in ("subfield", "field", "domain")])
    people = F.transform("p.authorships", _openalex_author)
    return record(
        _parsed(payloads, OPENALEX), "openalex", reason, source_id=c("p.id"), title=c("p.title"), venue=c("p.primary_location.source.display_name"), year=c("p.publication_year").cast("string"), doi=c("p.doi"),
        arxiv_id=c("p.ids.arxiv"), url=c("p.primary_location.landing_page_url"), abstract=F.array_join(F.transform(F.sort_array(at), lambda x: x["token"]), " "),
        keywords=F.transform("p.concepts", lambda x: x["display_name"]), categories=topic, authors=people)


def semantic_scholar(payloads: DataFrame, reason: str = "lookup_doi") -> DataFrame:
    people = F.transform("p.authors", lambda a: author(a["name"], a["externalIds"]["ORCID"], a["authorId"], F.transform(F.coalesce(a["affiliations"], _none("array<string>")), lambda x: affiliation(x))))
    return record(
        _parsed(payloads, SEMANTIC), "semantic_scholar", reason, source_id=c("p.paperId"), title=c("p.title"), venue=c("p.venue"), year=c("p.year").cast("string"), doi=c("p.externalIds.DOI"),
        arxiv_id=c("p.externalIds.ArXiv"), url=c("p.url"), abstract=c("p.abstract"), keywords=c("p.fieldsOfStudy"), categories=F.transform("p.s2FieldsOfStudy", lambda x: x["category"]), authors=people)
