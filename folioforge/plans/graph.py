"""Queries over the knowledge-base graph: papers, authors, organisations, provenance, and changes to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import dml
from ..operators import knowledge as K
from ..operators import merge as M
from ..operators.skew import attach_unique
from .relations import CANDIDATES, REQUESTS, candidates, requests, s_alias, s_arxiv, s_doi, s_title, table

c = F.col


def paper_with_authors(spark, d):
    edges = table(spark, d, "paper_authors").groupBy("paper_id", "author_id").agg(F.min("position").alias("position"))
    a = table(spark, d, "authors").select(c("id").alias("author_id"), "name", "orcid")
    return edges.join(a, "author_id").select("paper_id", "author_id", c("position").cast("long").alias("position"), "name", F.when(R.has(c("orcid")), 1).otherwise(0).alias("has_orcid"))


def author_profile(spark, d):
    n_papers = table(spark, d, "paper_authors").groupBy("author_id").agg(F.countDistinct("paper_id").alias("n_papers"))
    orgs = (
        table(spark, d, "author_orgs").select("author_id", "org_id").distinct().join(table(spark, d, "orgs").select(c("id").alias("org_id"), "name"), "org_id")
        .groupBy("author_id").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("orgs"), F.count(F.lit(1)).alias("n_orgs"))
    )
    a = table(spark, d, "authors").select(c("id").alias("author_id"), "name")
    none = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return a.join(n_papers, "author_id", "left").join(orgs, "author_id", "left").select("author_id", "name", none("n_papers"), none("n_orgs"), R.text(c("orgs")).alias("orgs"))


def papers_per_author(spark, d):
    return table(spark, d, "paper_authors").groupBy("author_id").agg(F.countDistinct("paper_id").alias("n_papers"))


def trend_by_year(spark, d):
    return candidates(spark, d).groupBy(R.digits_or_empty(c("year")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def _incoming(spark, d):
    """Discovery rows as new versions of the papers whose number they share, and as new papers."""
    q = requests(spark, d)
    return q.select(
        F.concat(F.lit("pap"), F.lpad(c("qid").cast("string"), 9, "0")).alias("id"), "title", F.nullif(R.bare_doi(c("doi")), F.lit("")).alias("doi"),
        F.nullif(c("venue"), F.lit("")).alias("venue"), F.lit("new").alias("created_at"),
    )


def _kb(spark, d):
    return table(spark, d, "papers").select("id", "title", "doi", "venue", F.lit("old").alias("created_at"))


def upsert_papers(spark, d):
    return dml.upsert(_kb(spark, d), _incoming(spark, d), "id")


def provenance_latest(spark, d):
    p = table(spark, d, "provenance").select("id", "entity_type", "entity_id", "confidence", "fetched_at", "loaded_at", "raw_ref")
    # a total order: equal times are told apart by all that is kept
    out = dml.latest(p.withColumns({"_t": F.coalesce(c("loaded_at"), F.lit("1970-01-01").cast("timestamp_ntz")), "_c": F.coalesce("confidence", F.lit(-1.0)), "_r": R.text(c("raw_ref"))}), ["id"], ["_t", "_c", "_r"])
    return out.select("id", "entity_type", "entity_id", "confidence", "raw_ref")


def provenance_by_entity(spark, d):
    """Rows, sources and mean confidence of each entity; one entity holds a tenth of the rows, so counts are combined early."""
    p = table(spark, d, "provenance")
    return p.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _byline(spark, d):
    return table(spark, d, "paper_authors").groupBy("paper_id", "author_id").agg(F.min("position").alias("position"))


def replace_edges(spark, d):
    """New bylines for the papers that discovery rows renumber: author of the same number, first place."""
    q = requests(spark, d)
    new = q.select(F.concat(F.lit("pap"), F.lpad(c("qid").cast("string"), 9, "0")).alias("paper_id"), F.concat(F.lit("aut"), F.lpad(c("qid").cast("string"), 8, "0")).alias("author_id"), F.lit(0).alias("position"))
    return dml.replace_children(_byline(spark, d), new, new, "paper_id").select("paper_id", "author_id", c("position").cast("long").alias("position"))


def cascade_delete(spark, d):
    """What is left of papers, bylines and provenance when papers without a title go."""
    papers = table(spark, d, "papers")
    gone = papers.where(R.text(c("title")) == "").select("id")
    left = dml.cascade({"papers": (papers.select("id"), "id"), "bylines": (table(spark, d, "paper_authors").select(c("paper_id").alias("id")), "id"),
                        "provenance": (table(spark, d, "provenance").where("entity_type = 'paper'").select(c("entity_id").alias("id")), "id")}, gone, "id")
    out = None
    for name, t in left.items():
        t = t.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "id", "n")
        out = t if out is None else out.unionByName(t)
    return out


def stale_authors(spark, d):
    """Authors without a paper."""
    return table(spark, d, "authors").select("id").join(table(spark, d, "paper_authors").select(c("author_id").alias("id")), "id", "left_anti")


def author_org_policy(spark, d):
    """Affiliations after a refresh: replaced for authors of one paper at most, added for the others, dropped with the last paper."""
    n = table(spark, d, "paper_authors").groupBy("author_id").agg(F.countDistinct("paper_id").alias("n"))
    old = table(spark, d, "author_orgs").select("author_id", "org_id").distinct()
    new = old.groupBy("author_id").agg(F.max("org_id").alias("org_id"))
    merged = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1))).groupBy("author_id", "org_id").agg(F.max("fresh").alias("fresh"))
    return merged.join(n, "author_id").where((c("n") > 1) | (c("fresh") == 1)).select("author_id", "org_id")


def discovery_load(spark, d):
    """Papers and provenance as a discovery run adds them: one provenance row for each row key, the last one staying."""
    q = requests(spark, d)
    key = R.fallback_key(c("source"), c("source_id"), c("title"), c("year"), c("doi"), c("arxiv_id"), c("url"))
    rows = q.select("qid", "source", key.alias("row_key"), R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")).alias("paper_id"))
    last = rows.groupBy("paper_id", "row_key").agg(F.max("qid").alias("qid"))
    return last.select(F.concat_ws("::", F.lit("paper"), "paper_id", "row_key").alias("id"), "qid")


def search_papers(spark, d, words="archive"):
    """All papers with the words in their title (case aside), latest year first."""
    p = table(spark, d, "papers").where(c("title").ilike(f"%{words}%")).select("id", "year")
    return M.ranked_all(p, [c("year").desc_nulls_last(), c("id")], "place").select("id", "place")


def find_by_identifier(spark, d):
    """The newest paper of each request's DOI and arXiv id, case aside, and how many have it."""
    q = requests(spark, d).select("qid", F.lower(R.bare_doi(c("doi"))).alias("qd"), F.lower(R.bare_arxiv(c("arxiv_id"))).alias("qa"))
    p = candidates(spark, d).join(table(spark, d, "papers").select("id", "updated_at", "created_at"), "id")
    old = F.lit(-(1 << 62))
    at = lambda x: -F.coalesce(F.unix_micros(c(x).cast("timestamp")), old)
    newest = F.min_by("id", F.struct(at("updated_at"), at("created_at"), c("id")))
    by_doi = p.where("doi != ''").groupBy(R.bare_doi(c("doi")).alias("qd")).agg(newest.alias("by_doi"), F.count(F.lit(1)).alias("n_doi"))
    by_arxiv = p.where("arxiv_id != ''").groupBy(R.bare_arxiv(c("arxiv_id")).alias("qa")).agg(newest.alias("by_arxiv"), F.count(F.lit(1)).alias("n_arxiv"))
    none = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return q.join(by_doi, "qd", "left").join(by_arxiv, "qa", "left").select("qid", R.text(c("by_doi")).alias("by_doi"), none("n_doi"), R.text(c("by_arxiv")).alias("by_arxiv"), none("n_arxiv"))


def cache_lookup(spark, d):
    """The stored paper of each request: by arXiv id, DOI, then a title that only one paper has; the newest of several."""
    p = table(spark, d, "papers").select("id", *[R.text(c(x)).alias(x) for x in ("title", "doi", "arxiv_id")], c("updated_at").alias("newest"))
    return K.cached(requests(spark, d), p)


def first_equivalent(spark, d):
    """The first stored paper that is the request's: same DOI, arXiv id (also by alias), or title and year with venues that don't contradict."""
    return K.equivalent(requests(spark, d), candidates(spark, d))


def restore_sources(spark, d, asked="openindex"):
    """Provenance of each paper as its sources: rows of the source asked, all if it has none of it; the last row of
    a source's key, best score first.  Places are counted over all rows at once, so a paper of very many is no burden."""
    p = table(spark, d, "provenance").where("entity_type = 'paper'")
    same = p.where(c("source") == asked).select("entity_id", F.lit(True).alias("same")).distinct()
    p = p.join(same, "entity_id", "left").where(c("same").isNull() | (c("source") == asked))
    order = F.struct(F.coalesce(c("loaded_at"), F.lit("1970-01-01").cast("timestamp_ntz")), F.coalesce(c("confidence"), F.lit(-1.0)))
    last = p.groupBy("entity_id", "source", "source_key").agg(F.max_by(F.coalesce("confidence", F.lit(-1.0)), order).alias("score"))
    out = M.ranked_all(last, [c("entity_id"), c("score").desc(), c("source").desc(), c("source_key").desc()], "n")
    first = out.groupBy("entity_id").agg(F.min("n").alias("n0"))
    return attach_unique(out, first, "entity_id").select("entity_id", (c("n") - c("n0") + 1).alias("place"), "source", "source_key", "score")


QUERIES = {
    "q_paper_with_authors": paper_with_authors, "q_author_profile": author_profile, "q_papers_per_author": papers_per_author, "q_trend_by_year": trend_by_year, "q_upsert_papers": upsert_papers,
    "q_provenance_latest": provenance_latest, "q_provenance_by_entity": provenance_by_entity, "q_replace_edges": replace_edges, "q_cascade_delete": cascade_delete, "q_stale_authors": stale_authors,
    "q_author_org_policy": author_org_policy, "q_discovery_load": discovery_load, "q_search_papers": search_papers, "q_find_by_identifier": find_by_identifier, "q_cache_lookup": cache_lookup,
    "q_first_equivalent": first_equivalent, "q_restore_sources": restore_sources,
}

_PID = "concat('pap', lpad(CAST(qid AS VARCHAR), 9, '0'))"
_BYLINE = "SELECT paper_id, author_id, min(position) AS position FROM paper_authors GROUP BY 1, 2"
_QA = f"coalesce(nullif({s_arxiv('arxiv_id')}, ''), {s_alias('doi')})"
_YEAR = "CASE WHEN regexp_matches(trim(year, ' '), '^[0-9]+$') THEN trim(year, ' ') ELSE '' END"
_SRC = "lower(trim(CASE WHEN source <> '' THEN source ELSE 'unknown' END, ' '))"
_GIVEN = f"(CASE WHEN arxiv_id <> '' THEN {s_arxiv('arxiv_id')} ELSE {s_arxiv('arxiv_url')} END)"

SQL = {
    "q_paper_with_authors": f"SELECT e.paper_id, e.author_id, CAST(e.position AS BIGINT) AS position, a.name, CASE WHEN coalesce(a.orcid, '') <> '' THEN 1 ELSE 0 END AS has_orcid FROM ({_BYLINE}) e JOIN authors a ON e.author_id = a.id",
    "q_author_profile": """SELECT a.id AS author_id, a.name, coalesce(p.n, 0) AS n_papers, coalesce(o.n, 0) AS n_orgs, coalesce(o.orgs, '') AS orgs FROM authors a
LEFT JOIN (SELECT author_id, count(DISTINCT paper_id) AS n FROM paper_authors GROUP BY 1) p ON a.id = p.author_id
LEFT JOIN (SELECT x.author_id, count(*) AS n, string_agg(o.name, '; ' ORDER BY o.name) AS orgs FROM (SELECT DISTINCT author_id, org_id FROM author_orgs) x JOIN orgs o ON x.org_id = o.id GROUP BY 1) o ON a.id = o.author_id""",
    "q_papers_per_author": "SELECT author_id, count(DISTINCT paper_id) AS n_papers FROM paper_authors GROUP BY 1",
    "q_trend_by_year": f"SELECT {_YEAR} AS year, count(*) AS n FROM ({CANDIDATES}) GROUP BY 1",
    "q_upsert_papers": f"""WITH n AS (SELECT {_PID} AS id, title, nullif({s_doi('doi')}, '') AS doi, nullif(venue, '') AS venue FROM ({REQUESTS}))
SELECT coalesce(p.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE p.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.doi ELSE p.doi END AS doi,
  CASE WHEN n.id IS NOT NULL THEN n.venue ELSE p.venue END AS venue, CASE WHEN p.id IS NOT NULL THEN 'old' ELSE 'new' END AS created_at FROM papers p FULL OUTER JOIN n ON p.id = n.id""",
    "q_provenance_latest": """SELECT id, entity_type, entity_id, confidence, raw_ref FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(loaded_at, TIMESTAMP '1970-01-01') DESC, coalesce(confidence, -1) DESC, coalesce(raw_ref, '') DESC) AS n FROM provenance) WHERE n = 1""",
    "q_provenance_by_entity": "SELECT entity_type, entity_id, count(*) AS n, count(DISTINCT source) AS n_sources, round(avg(confidence), 6) AS confidence FROM provenance GROUP BY 1, 2",
    "q_replace_edges": f"""WITH n AS (SELECT {_PID} AS paper_id, concat('aut', lpad(CAST(qid AS VARCHAR), 8, '0')) AS author_id FROM ({REQUESTS}))
SELECT paper_id, author_id, CAST(position AS BIGINT) AS position FROM ({_BYLINE}) WHERE paper_id NOT IN (SELECT paper_id FROM n) UNION ALL SELECT paper_id, author_id, 0 FROM n""",
    "q_cascade_delete": """WITH g AS (SELECT id FROM papers WHERE coalesce(title, '') = '')
SELECT 'papers' AS relation, id, count(*) AS n FROM papers WHERE id NOT IN (SELECT id FROM g) GROUP BY 2
UNION ALL SELECT 'bylines', paper_id, count(*) FROM paper_authors WHERE paper_id NOT IN (SELECT id FROM g) GROUP BY 2
UNION ALL SELECT 'provenance', entity_id, count(*) FROM provenance WHERE entity_type = 'paper' AND entity_id NOT IN (SELECT id FROM g) GROUP BY 2""",
    "q_stale_authors": "SELECT id FROM authors WHERE id NOT IN (SELECT author_id FROM paper_authors WHERE author_id IS NOT NULL)",
    "q_author_org_policy": """WITH o AS (SELECT DISTINCT author_id, org_id FROM author_orgs), m AS (SELECT author_id, max(org_id) AS org_id FROM o GROUP BY 1), n AS (SELECT author_id, count(DISTINCT paper_id) AS n FROM paper_authors GROUP BY 1)
SELECT o.author_id, o.org_id FROM o JOIN n ON o.author_id = n.author_id JOIN m ON o.author_id = m.author_id WHERE n.n > 1 OR o.org_id = m.org_id""",
    "q_discovery_load": f"""WITH r AS (SELECT *, CASE WHEN trim(source_id, ' ') <> '' THEN concat({_SRC}, ':', trim(source_id, ' ')) ELSE concat({_SRC}, ':fallback:', substr(sha1(concat_ws('|', {_SRC}, title, year, doi, arxiv_id, url)), 1, 16)) END AS row_key,
  CASE WHEN {s_doi('doi')} <> '' THEN concat('doi:', {s_doi('doi')}) WHEN {s_arxiv('arxiv_id')} <> '' THEN concat('arxiv:', {s_arxiv('arxiv_id')}) ELSE concat('title:', {s_title('title')}, ':', year) END AS paper_id FROM ({REQUESTS}))
SELECT concat_ws('::', 'paper', paper_id, row_key) AS id, max(qid) AS qid FROM r GROUP BY 1""",
    "q_search_papers": "SELECT id, row_number() OVER (ORDER BY year DESC NULLS LAST, id) AS place FROM papers WHERE title ILIKE '%archive%'",
    "q_find_by_identifier": f"""WITH p AS (SELECT c.*, x.updated_at, x.created_at FROM ({CANDIDATES}) c JOIN papers x USING (id)), w AS (SELECT *, {s_doi('doi')} AS kd, {s_arxiv('arxiv_id')} AS ka FROM p),
d AS (SELECT kd AS k, id AS i, n FROM (SELECT *, count(*) OVER (PARTITION BY kd) AS n, row_number() OVER (PARTITION BY kd ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, id) AS r FROM w WHERE doi <> '') WHERE r = 1),
a AS (SELECT ka AS k, id AS i, n FROM (SELECT *, count(*) OVER (PARTITION BY ka) AS n, row_number() OVER (PARTITION BY ka ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, id) AS r FROM w WHERE arxiv_id <> '') WHERE r = 1),
q AS (SELECT qid, {s_doi('doi')} AS qd, {s_arxiv('arxiv_id')} AS qa FROM ({REQUESTS}))
SELECT q.qid, coalesce(d.i, '') AS by_doi, coalesce(d.n, 0) AS n_doi, coalesce(a.i, '') AS by_arxiv, coalesce(a.n, 0) AS n_arxiv FROM q LEFT JOIN d ON q.qd = d.k LEFT JOIN a ON q.qa = a.k""",
    "q_cache_lookup": f"""WITH p AS (SELECT id, updated_at, coalesce(title, '') AS title, coalesce(doi, '') AS doi, coalesce(arxiv_id, '') AS arxiv_id FROM papers),
k AS (SELECT id, updated_at, {s_doi('doi')} AS d, CASE WHEN {s_arxiv('arxiv_id')} <> '' THEN {s_arxiv('arxiv_id')} ELSE {s_alias('doi')} END AS a, {s_title('title')} AS t FROM p),
a AS (SELECT a AS k, id AS i FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY updated_at DESC NULLS LAST, id) AS r FROM k) WHERE r = 1), d AS (SELECT d AS k, id AS i FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY updated_at DESC NULLS LAST, id) AS r FROM k) WHERE r = 1),
t AS (SELECT t AS k, min(id) AS i FROM k GROUP BY 1 HAVING count(*) = 1),
q AS (SELECT qid, CASE WHEN {s_alias('doi')} <> '' THEN '' ELSE {s_doi('doi')} END AS qd, CASE WHEN {_GIVEN} <> '' THEN {_GIVEN} ELSE {s_alias('doi')} END AS qa, {s_title('title')} AS qt FROM ({REQUESTS}))
SELECT q.qid, CASE WHEN a.i IS NOT NULL THEN 'arxiv' WHEN d.i IS NOT NULL THEN 'doi' WHEN t.i IS NOT NULL THEN 'title' ELSE 'miss' END AS found_by, coalesce(a.i, d.i, t.i, '') AS paper
FROM q LEFT JOIN a ON q.qa = a.k AND a.k <> '' LEFT JOIN d ON q.qd = d.k AND d.k <> '' LEFT JOIN t ON q.qt = t.k AND t.k <> ''""",
    "q_first_equivalent": f"""WITH p AS (SELECT ord, {s_doi('doi')} AS d, {_QA} AS a, {s_title('title')} AS t, {_YEAR} AS y, {s_title('venue')} AS v FROM ({CANDIDATES})),
q AS (SELECT qid, {s_doi('doi')} AS d, {_QA} AS a, {s_title('title')} AS t, {_YEAR} AS y, {s_title('venue')} AS v FROM ({REQUESTS})),
m AS (SELECT qid, ord FROM q JOIN p ON q.d = p.d WHERE q.d <> '' UNION ALL SELECT qid, ord FROM q JOIN p ON q.a = p.a WHERE q.a <> ''
  UNION ALL SELECT qid, ord FROM q JOIN p ON q.t = p.t AND q.y = p.y WHERE q.t <> '' AND q.y <> '' AND (q.v = '' OR p.v = '' OR q.v = p.v))
SELECT qid, min(ord) AS ord FROM m GROUP BY 1""",
    "q_restore_sources": """WITH p AS (SELECT * FROM provenance WHERE entity_type = 'paper'), s AS (SELECT * FROM p WHERE source = 'openindex' OR entity_id NOT IN (SELECT entity_id FROM p WHERE source = 'openindex')),
l AS (SELECT entity_id, source, source_key, coalesce(confidence, -1) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source, source_key ORDER BY coalesce(loaded_at, TIMESTAMP '1970-01-01') DESC, coalesce(confidence, -1) DESC) AS n FROM s) WHERE n = 1)
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, source DESC, source_key DESC) AS place, source, source_key, score FROM l""",
}
