"""Retrieval by the three policies, and what is stored afterwards, on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioforge.operators import knowledge as K
from folioforge.operators import merge as M
from folioforge.sources import payloads as P

ROW = "ord long, source string, title string, venue string, year string, doi string, arxiv_id string, url string, abstract string, keywords array<string>, categories array<string>, score double"
ASK = "qid long, doi string, arxiv_url string, arxiv_id string, title string"
PAPER = "id string, title string, venue string, year string, doi string, arxiv_id string, newest timestamp"
ORG = "array<struct<org_id: string, name: string, ror: string, country: string>>"
SOURCES = ["first", "second"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, "first", "Map Scans", "", "", "10.1/a", "", "", "", [], [], 0.5), (2, "second", "Map Scans", "Annals", "2020", "10.1/a", "", "", "We scan.", [], [], 0.4),
        (3, "first", "Sea Charts", "Annals", "2021", "10.1/b", "", "", "We chart.", ["sea"], [], 0.5), (4, "second", "Sea Charts (v2)", "", "", "10.1/b", "2001.00001", "", "", [], [], 0.9),
        (5, None, None, None, None, None, None, None, None, None, None, None),
    ], ROW)


def test_policies(spark, rows):
    ask = spark.createDataFrame([(1, "10.1/a", "", "", ""), (2, "10.1/B", "", "", ""), (3, "10.1/none", "", "", ""), (4, "", "", "", "Kept Title"), (5, None, None, None, None), (6, "doi:10.1/c", "", "", "")], ASK)
    kb = spark.createDataFrame([("old", "kept title!", "", "", "10.1/c", "", datetime(2020, 1, 1)), ("new", "x", "", "", "10.1/C", "", datetime(2021, 1, 1)), ("un", None, None, None, None, None, None)], PAPER)
    got = lambda policy: {r.qid: (r.status, r.strategy, r.paper_id) for r in K.retrieve(ask, rows, kb, SOURCES, policy).collect()}
    fall = "cache_miss_fast_incomplete_fallback_consensus"
    assert got("cache_first") == {1: ("resolved", fall, "doi:10.1/a"), 2: ("resolved", "fast", "doi:10.1/b"), 3: ("not_found", "fast", ""), 4: ("resolved", "cache_hit", "old"), 6: ("resolved", "cache_hit", "new")}
    assert {k: v[:2] for k, v in got("fast").items()} == {1: ("resolved", "fast"), 2: ("resolved", "fast"), 3: ("not_found", "fast"), 6: ("not_found", "fast")}
    assert {k: v[0] for k, v in got("consensus").items()} == {1: "resolved", 2: "resolved", 3: "not_found", 6: "not_found"}
    years = {r.qid: (r.year, r.n_sources) for r in K.retrieve(ask, rows, kb.limit(0), SOURCES).collect()}
    assert years[1] == ("2020", 2) and years[2] == ("2021", 1)
    assert K.retrieve(ask.limit(0), rows, kb, SOURCES).count() == 0 and {r.status for r in K.retrieve(ask, rows.limit(0), kb.limit(0), SOURCES).collect()} == {"not_found"}


def test_reconciliation(spark):
    rec = "qid long, paper_id string, doi string, arxiv_id string, title string, year string, venue string"
    ent = "ord long, paper_id string, doi string, arxiv_id string, title string, year string, venue string"
    records = spark.createDataFrame([(1, "arxiv:2001.1", "", "2001.11111", "t", "2020", ""), (2, "title:sea charts:2020", "", "", "Sea charts", "2020", "Annals"), (3, "title:sea charts:2020", "", "", "Sea charts", "2020", "Letters"), (4, "same", "10.1/z", "", None, None, None)], rec)
    entries = spark.createDataFrame([(1, "a", "10.48550/arxiv.2001.11111", "", "x", "", ""), (2, "b", "10.1/b", "", "SEA CHARTS", "2020", "annals"), (3, "same", "10.1/z", "2002.1", "", "", "")], ent)
    got = {r.qid: (r.paper_id, r.doi, r.arxiv_id) for r in K.reconciled(records, entries).collect()}
    assert got == {1: ("a", "10.48550/arxiv.2001.11111", "2001.11111"), 2: ("b", "10.1/b", ""), 3: ("title:sea charts:2020", "", ""), 4: ("same", "10.1/z", "")}


def test_index_entries(spark):
    index = spark.createDataFrame([("p", "old", ["k0"], 5, "fast", "t0", "t0"), ("q", "kept", ["k9"], 1, "fast", "t0", "t0")], "paper_id string, title string, query_keys array<string>, source_count long, policy string, first_seen string, last_seen string")
    results = spark.createDataFrame([(1, "p", "new", "k1", ["kp"], 2, "consensus"), (2, "n", "one", "k2", ["kn"], 3, "fast"), (3, "n", "two", "k3", ["kn"], 1, "fast"), (4, "m", "only", "k4", ["km"], 1, "fast")],
                                    "qid long, paper_id string, title string, query_key string, paper_keys array<string>, n_sources long, policy string")
    got = {r.paper_id: (r.title, r.query_keys, r.source_count, r.policy, r.first_seen, r.last_seen) for r in K.upsert_entries(index, results, F.lit("t1")).collect()}
    assert got == {"p": ("new", ["k0", "k1", "kp"], 5, "consensus", "t0", "t1"), "q": ("kept", ["k9"], 1, "fast", "t0", "t0"), "n": ("two", ["k2", "k3", "kn"], 3, "fast", "t1", "t1"), "m": ("only", ["k4"], 1, "fast", "t1", "t1")}


def test_persistence_and_deletion(spark):
    df = spark.createDataFrame
    kb = {
        "papers": df([("p1", "old", None, None, None, None), ("p2", "other", None, None, None, None)], "id string, title string, venue string, year int, doi string, arxiv_id string"),
        "authors": df([("a1", "Ann", None), ("a2", "Bo", None)], "id string, name string, orcid string"), "orgs": df([], "id string, name string, ror string, country string"),
        "bylines": df([("p1", "a2", 0), ("p2", "a1", 0)], "paper_id string, author_id string, position int"), "metadata": df([], f"paper_id string, author_id string, source_ids array<string>, affiliations {ORG}"),
        "author_orgs": df([("a1", "o9", "lead"), ("a2", "o8", None)], "author_id string, org_id string, role string"), "provenance": df([], "id string, entity_type string, entity_id string, source string, source_key string"),
    }
    people = lambda *x: [(i, n, "", [], [(o, o.upper(), "", "")] if o else []) for i, n, o in x]
    results = df([(1, "p1", "first", None, "2020", "10.1/a", "", people(("a3", "Cy", "o1"))), (2, "p1", "last", "V", "x", "10.1/a", "", people(("a1", "Ann B", "o1"), ("a3", "Cy", ""), ("", "none", "")))],
                 f"qid long, paper_id string, title string, venue string, year string, doi string, arxiv_id string, authors array<struct<author_id: string, name: string, orcid: string, source_ids: array<string>, affiliations: {ORG}>>")
    new = K.persisted(kb, results, df([("p1", "xref", "7"), ("p1", "", "8")], "paper_id string, source string, source_key string"))
    rows = lambda name: sorted(map(tuple, new[name].collect()), key=str)
    assert rows("papers") == [("p1", "last", "V", None, "10.1/a", None), ("p2", "other", None, None, None, None)]
    assert rows("authors") == [("a1", "Ann B", None), ("a2", "Bo", None), ("a3", "Cy", None)] and [r[0] for r in rows("orgs")] == ["o1"]
    assert rows("bylines") == [("p1", "a1", 0), ("p1", "a3", 1), ("p2", "a1", 0)]
    assert rows("author_orgs") == [("a1", "o1", None), ("a1", "o9", "lead")]  # added for a1, who has two papers; gone with a2's last one
    assert {r[0] for r in rows("provenance")} == {"paper::p1::resolver::10.1/a", "author::a1::resolver::a1", "author::a3::resolver::a3", "paper_author::p1::a1::resolver::0", "paper_author::p1::a3::resolver::1", "org::o1::resolver::O1", "author_org::a1::o1::resolver::O1", "paper::p1::xref::7"}
    left = K.without_papers(new, df([("p1",)], "id string"))
    assert [r.id for r in left["papers"].collect()] == ["p2"] and [r.author_id for r in left["bylines"].collect()] == ["a1"] and left["metadata"].count() == 0
    assert {r.entity_type for r in left["provenance"].collect()} == {"author", "org", "author_org"}
    empty = K.persisted(kb, results.limit(0), df([], "paper_id string, source string, source_key string"))
    assert {k: v.count() for k, v in empty.items()} == {k: v.count() for k, v in kb.items()}


def test_ranking_without_one_task(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    got = M.ranked_all(rows, [F.col("x").desc(), F.col("id")]).orderBy("rank").collect()
    assert [r.id for r in got] == sorted(range(1000), key=lambda i: (-(i % 7), i)) and [r["rank"] for r in got] == list(range(1, 1001))
    assert M.ranked_all(rows.limit(0), [F.col("x"), F.col("id")]).count() == 0


def test_payloads_of_broken_and_bare_answers(spark):
    pay = spark.createDataFrame([("broken",), ("{}",), (None,), ('{"id": "W1", "title": " T ", "doi": "https://doi.org/10.1/X", "abstract_inverted_index": {"b": [1, 3], "a": [0], "c": [2]}, "authorships": [{"author": {"display_name": " Ann ", "orcid": "https://orcid.org/0000-1"}, "institutions": [{"ror": ""}, {"display_name": "U", "country_code": "NL"}]}]}',)], "payload string")
    got = {r.source_id: r for r in P.openalex(pay, "search_title").collect()}
    w = got["W1"]
    assert (w.title, w.doi, w.abstract, w.score, w.authors[0].name, w.authors[0].orcid, [tuple(a) for a in w.authors[0].affiliations]) == ("T", "10.1/x", "a b c b", 0.7, "Ann", "0000-1", [("U", "", "NL")])
    for read, reasons in ((P.crossref, ("lookup_doi", "open_query")), (P.arxiv, ("lookup_arxiv", "search_title")), (P.semantic_scholar, ("lookup_doi", "search_title"))):
        for reason in reasons:
            assert all(r.title == "" and r.authors == [] and r.doi == "" for r in read(pay.limit(3), reason).where("title = ''").collect())


def test_abstracts_are_inverted_once(spark):
    from folioforge.plans import knowledge

    rows, places = knowledge._word_places(spark.createDataFrame([("b a  b &amp; a b",), ("",)], "abstract string"))
    got = [{e["key"]: list(e["value"]) for e in r[0]} for r in rows.select(places).collect()]
    assert got == [{"b": [0, 2, 5], "a": [1, 4], "&": [3]}, {"": [0]}]
    for q in (knowledge.openalex_records, knowledge.openalex_authors, knowledge.crossref_records):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [x for x in plan if x.strip(" :+-").startswith("Filter") and "from_json" in x]


def test_bylines_are_the_authors_of_records(spark):
    from folioforge.plans import knowledge

    pay = spark.createDataFrame([("broken",), ("{}",), (None,), ('{"id": " W1 ", "abstract_inverted_index": {"b": [1]}, "authorships": [{"author": {"display_name": " Ann ", "orcid": "ORCID:0000-1"}, "institutions": [{"ror": ""}, {"display_name": "U"}]}, null, {"author": null}]}',), ('{"id": "W2", "authorships": []}',)], "payload string")
    of_records = P.openalex(pay).select("source_id", F.posexplode("authors").alias("place", "author"))
    got = P.openalex_bylines(pay)
    assert sorted(map(str, got.collect())) == sorted(map(str, of_records.collect())) and got.count() == 3
    parsed = [x for x in knowledge.openalex_authors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "from_json" in x and "authorships" in x]
    assert parsed and not [x for x in parsed if "concepts" in x]
