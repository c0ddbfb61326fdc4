"""Queries that look up, resolve and store: the cache-first chain, the index of entries, and the knowledge base after results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import knowledge as K
from ..operators import merge as M
from ..operators.resolve import with_lookup_ids
from ..sources import payloads as P
from .relations import CANDIDATES, REQUESTS, candidates, requests, s_alias, s_arxiv, s_clean, s_doi, s_paper_id, s_title, table
from .scalars import _EFF, _KEYS
from .search import _ASKED, _IDENT, SOURCES

c = F.col


def _papers(spark, d):
    return table(spark, d, "papers").select("id", *[R.text(c(x).cast("string")).alias(x) for x in ("title", "venue", "year", "doi", "arxiv_id")], c("updated_at").alias("newest"))


def cache_first(spark, d):
    """Each request that the knowledge base has or that names an identifier: stored, of the first source, or of all."""
    out = K.retrieve(requests(spark, d), candidates(spark, d), _papers(spark, d), SOURCES)
    return out.select("qid", "mode", "status", "strategy", "paper_id")


def _numbered(column, prefix, width):
    return F.concat(F.lit(prefix), F.lpad(column.cast("string"), width, "0"))


def _people(spark, d):
    """author_id, orgs: each author's different organisations in order of their ids."""
    o = table(spark, d, "orgs").select(c("id").alias("org_id"), *[R.text(c(x)).alias(x) for x in ("name", "ror", "country")])
    of = table(spark, d, "author_orgs").select("author_id", "org_id").distinct().join(o, "org_id")
    return of.groupBy("author_id").agg(F.array_sort(F.collect_list(F.struct("org_id", "name", "ror", "country"))).alias("orgs"))


def persist_resolved(spark, d):
    """The knowledge base after the discovery rows were resolved as papers of their numbers, each by the author of its number."""
    kb = {
        "papers": table(spark, d, "papers").select("id", "title", "venue", "year", "doi", "arxiv_id"), "authors": table(spark, d, "authors").select("id", "name", "orcid"),
        "orgs": table(spark, d, "orgs").select("id", "name", "ror", "country"), "bylines": table(spark, d, "paper_authors").groupBy("paper_id", "author_id").agg(F.min("position").cast("int").alias("position")),
        "author_orgs": table(spark, d, "author_orgs").groupBy("author_id", "org_id").agg(F.max("role").alias("role")),
        "provenance": table(spark, d, "provenance").select("id", "entity_type", "entity_id", "source", "source_key").dropDuplicates(["id"]),
    }
    none = F.array().cast("array<string>")
    org = "array<struct<org_id: string, name: string, ror: string, country: string>>"
    kb["metadata"] = kb["bylines"].select("paper_id", "author_id", none.alias("source_ids"), F.array().cast(org).alias("affiliations"))
    q = requests(spark, d)
    a = table(spark, d, "authors").select(c("id").alias("author_id"), R.text(c("name")).alias("name"), R.text(c("orcid")).alias("orcid")).join(_people(spark, d), "author_id", "left")
    author = F.struct("author_id", "name", "orcid", none.alias("source_ids"), F.coalesce(F.slice("orgs", 1, 1), F.array().cast(org)).alias("affiliations"))
    q = q.withColumn("author_id", _numbered(c("qid"), "aut", 8)).join(a.withColumn("a", author).select("author_id", "a"), "author_id", "left")
    results = q.select("qid", _numbered(c("qid"), "pap", 9).alias("paper_id"), "title", "venue", "year", R.bare_doi(c("doi")).alias("doi"), R.bare_arxiv(c("arxiv_id")).alias("arxiv_id"), F.array_compact(F.array("a")).alias("authors"))
    sources = q.select(_numbered(c("qid"), "pap", 9).alias("paper_id"), "source", F.coalesce(F.nullif("source_id", F.lit("")), F.nullif("doi", F.lit("")), "arxiv_id").alias("source_key"))
    new = K.persisted(kb, results, sources)
    shown = {
        "papers": ("id", F.concat_ws("|", F.md5(R.text(c("title"))), R.text(c("doi")), R.text(c("year").cast("string")))), "authors": ("id", R.text(c("name"))), "orgs": ("id", R.text(c("name"))),
        "bylines": (F.concat_ws("|", "paper_id", "author_id"), R.text(c("position").cast("string"))), "metadata": (F.concat_ws("|", "paper_id", "author_id"), F.size("affiliations").cast("string")),
        "author_orgs": (F.concat_ws("|", "author_id", "org_id"), R.text(c("role"))), "provenance": ("id", c("entity_type")),
    }
    out = None
    for name, (key, value) in shown.items():
        t = new[name].select(F.lit(name).alias("relation"), (c(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))
        out = t if out is None else out.unionByName(t)
    return out


def _results(spark, d):
    """Discovery rows as results, two in a row for one paper."""
    q = with_lookup_ids(requests(spark, d)).withColumn("tn", R.title_words(c("title")))
    key = F.when(c("eff_doi") != "", F.concat(F.lit("doi:"), "eff_doi")).when(c("eff_arxiv") != "", F.concat(F.lit("arxiv:"), "eff_arxiv")).when(c("tn") != "", F.concat(F.lit("title:"), "tn")).otherwise("empty")
    q = q.select("qid", _numbered(F.floor(c("qid") / 2), "pap", 9).alias("paper_id"), "title", key.alias("query_key"), (c("qid") % 5).alias("n_sources"), F.lit("cache_first").alias("policy"),
                 R.bare_doi(c("doi")).alias("d"), R.bare_arxiv(c("arxiv_id")).alias("a"), "tn")
    q = q.withColumn("al", R.alias_arxiv(c("d")))
    return q.select("qid", "paper_id", "title", "query_key", R.key_set(c("paper_id"), c("d"), c("a"), c("al"), c("tn")).alias("paper_keys"), "n_sources", "policy")


def entry_upsert(spark, d):
    """The index after results: titles, query keys, numbers of sources, policies and times of its entries."""
    index = table(spark, d, "papers").select(c("id").alias("paper_id"), R.text(c("title")).alias("title"), F.array(F.concat(F.lit("id:"), "id")).alias("query_keys"), F.lit(2).cast("long").alias("source_count"), F.lit("fast").alias("policy"), F.lit("t0").alias("first_seen"), F.lit("t0").alias("last_seen"))
    out = K.upsert_entries(index, _results(spark, d), F.lit("t1"))
    return out.select("paper_id", F.md5("title").alias("title_md5"), F.md5(F.array_join("query_keys", "|")).alias("keys_md5"), "source_count", "policy", "first_seen", "last_seen")


def reconciled(spark, d):
    """Requests as records, with the id of the first stored entry that is their paper and its identifiers where they lack their own."""
    q = requests(spark, d)
    doi, arxiv = R.bare_doi(c("doi")), R.bare_arxiv(c("arxiv_id"))
    records = q.select("qid", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")).alias("paper_id"), doi.alias("doi"), arxiv.alias("arxiv_id"), "title", "year", "venue")
    entries = candidates(spark, d).select("ord", c("id").alias("paper_id"), R.bare_doi(c("doi")).alias("doi"), R.bare_arxiv(c("arxiv_id")).alias("arxiv_id"), "title", "year", "venue")
    return K.reconciled(records, entries).select("qid", "paper_id", "doi", "arxiv_id")


def delete_papers(spark, d):
    """What is left of the knowledge base, by relation, when papers without a title go."""
    papers = table(spark, d, "papers").select("id", "title")
    byline = table(spark, d, "paper_authors").select("paper_id", "author_id", "position")
    own = byline.select("paper_id", "author_id").distinct().select(F.lit("paper_author").alias("entity_type"), F.concat_ws("::", "paper_id", "author_id").alias("entity_id"))
    kb = {"papers": papers, "bylines": byline, "metadata": byline.select("paper_id", "author_id").distinct(), "provenance": table(spark, d, "provenance").select("entity_type", "entity_id").unionByName(own)}
    left = K.without_papers(kb, papers.where(R.text(c("title")) == ""))
    key = {"papers": c("id"), "bylines": c("paper_id"), "metadata": c("paper_id"), "provenance": F.concat_ws(" ", "entity_type", "entity_id")}
    out = None
    for name, t in left.items():
        t = t.groupBy(key[name].alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "id", "n")
        out = t if out is None else out.unionByName(t)
    return out


def rank_all(spark, d):
    """Every candidate record with its rank."""
    keyed = candidates(spark, d).withColumn("key", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")))
    return M.ranked(keyed).select("rank", "key", "id")


def _authored(spark, d):
    """Candidates with their authors in order, as services deliver them."""
    each = table(spark, d, "paper_authors").groupBy("paper_id", "author_id").agg(F.min(F.coalesce("position", F.lit(10**6))).cast("int").alias("position"))
    a = table(spark, d, "authors").select(c("id").alias("author_id"), R.text(c("name")).alias("name"), R.text(c("orcid")).alias("orcid")).join(_people(spark, d), "author_id", "left")
    who = F.struct("position", "author_id", "name", "orcid", F.coalesce("orgs", F.array().cast("array<struct<org_id: string, name: string, ror: string, country: string>>")).alias("orgs"))
    lists = each.join(a, "author_id").groupBy(c("paper_id").alias("id")).agg(F.array_sort(F.collect_list(who)).alias("who"))
    return candidates(spark, d).join(lists, "id", "left")


def _word_places(p):
    """Rows with what it takes, and the entries of their abstracts' words with all places, as the service gives abstracts.

    Words are sorted with their places, so each run of one word is an entry: a pass over the words, not one for each
    different word.  The steps are columns of their own, as an expression inside a lambda is worked out for every element;
    words and places are parted after sorting and taken one at a time, as ``slice`` copies the whole list first.  A step that is
    used once, or that only takes a field, would be put into the lambda all the same: hence ``transform`` and the size of ``_i``.
    """
    p = p.withColumn("_words", R.clean_words(c("abstract")))
    p = p.withColumn("_sorted", F.sort_array(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    p = p.withColumns({"_w": F.transform("_sorted", lambda x: x["w"]), "_i": F.transform("_sorted", lambda x: x["i"])})
    p = p.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1))))
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_i"))
    return p, F.transform("_starts", lambda at, k: F.struct(F.get("_w", at).alias("key"), F.transform(F.sequence(at, end(k) - 1), lambda j: F.get("_i", j)).alias("value")))


def _openalex_payloads(spark, d):
    p = _authored(spark, d)
    inst = lambda o: F.struct(o["name"].alias("display_name"), o["ror"].alias("ror"), o["country"].alias("country_code"))
    ship = F.transform("who", lambda w: F.struct(F.struct(w["author_id"].alias("id"), w["name"].alias("display_name"), w["orcid"].alias("orcid")).alias("author"), F.transform(w["orgs"], inst).alias("institutions")))
    p, places = _word_places(p)
    topic = F.struct(*[F.struct(F.try_element_at(c("categories"), F.lit(i)).alias("display_name")).alias(k) for i, k in enumerate(("subfield", "field", "domain"), 1)])
    item = F.struct(
        "id", "title", "doi", F.nullif(R.digits_or_empty(c("year")), F.lit("")).cast("int").alias("publication_year"), F.struct(c("arxiv_id").alias("arxiv")).alias("ids"), F.map_from_entries(places).alias("abstract_inverted_index"),
        F.transform("keywords", lambda k: F.struct(k.alias("display_name"))).alias("concepts"), topic.alias("primary_topic"), ship.alias("authorships"),
        F.struct(c("url").alias("landing_page_url"), F.struct(c("venue").alias("display_name")).alias("source")).alias("primary_location"))
    return p.select(F.to_json(item).alias("payload"))


def _shown(rows):
    return rows.select("source_id", "title", "venue", "year", "doi", "arxiv_id", "url", F.md5("abstract").alias("abstract_md5"), F.array_join("keywords", "|").alias("keywords"), F.array_join("categories", "|").alias("categories"), F.size("authors").cast("long").alias("n_authors"), "score", "reason")


def openalex_records(spark, d):
    return _shown(P.openalex(_openalex_payloads(spark, d), "lookup_arxiv"))


def openalex_authors(spark, d):
    """The authors of each record in order, with their affiliations."""
    a = P.openalex_bylines(_openalex_payloads(spark, d))
    return a.select(c("source_id").alias("id"), c("place").cast("long").alias("place"), "author.name", "author.orcid", c("author.source_id").alias("author"), F.array_join(F.transform("author.affiliations", lambda o: F.concat_ws("/", o["name"], o["ror"], o["country"])), "; ").alias("affiliations"))


def arxiv_rows(spark, d):
    p = _authored(spark, d).where("arxiv_id != ''")
    item = F.struct(F.concat(F.lit("https://arxiv.org/abs/"), R.bare_arxiv(c("arxiv_id"))).alias("entry_id"), "title", F.concat(R.digits_or_empty(c("year")), F.lit("-01-02T00:00:00Z")).alias("published"), c("abstract").alias("summary"), "categories", F.transform("who", lambda w: F.struct(w["name"].alias("name"))).alias("authors"))
    return _shown(P.arxiv(p.select(F.to_json(item).alias("payload"))))


def crossref_records(spark, d):
    p = _authored(spark, d)
    y = F.nullif(R.digits_or_empty(c("year")), F.lit("")).cast("int")
    who = F.transform("who", lambda w: F.struct(F.lit("A").alias("given"), w["name"].alias("family"), w["orcid"].alias("ORCID"), F.transform(w["orgs"], lambda o: F.struct(o["name"].alias("name"))).alias("affiliation")))
    item = F.struct(c("doi").alias("DOI"), F.array("title").alias("title"), F.array("venue").alias("container-title"), F.when(y.isNotNull(), F.struct(F.array(F.array(y)).alias("date-parts"))).alias("issued"), c("url").alias("URL"), "abstract", c("keywords").alias("subject"), who.alias("author"))
    return _shown(P.crossref(p.select(F.to_json(item).alias("payload"))))


def semantic_records(spark, d):
    p = _authored(spark, d)
    who = F.transform("who", lambda w: F.struct(w["author_id"].alias("authorId"), w["name"].alias("name"), F.struct(w["orcid"].alias("ORCID")).alias("externalIds"), F.transform(w["orgs"], lambda o: o["name"]).alias("affiliations")))
    item = F.struct(c("id").alias("paperId"), "title", "venue", F.nullif(R.digits_or_empty(c("year")), F.lit("")).cast("int").alias("year"), F.struct(c("doi").alias("DOI"), c("arxiv_id").alias("ArXiv")).alias("externalIds"), "url", "abstract",
                    c("keywords").alias("fieldsOfStudy"), F.transform("categories", lambda x: F.struct(x.alias("category"))).alias("s2FieldsOfStudy"), who.alias("authors"))
    return _shown(P.semantic_scholar(p.select(F.to_json(item).alias("payload")), "search_title"))


def merge_authors(spark, d):
    """Authors of each record's rows as one: first name and ORCID, source ids and affiliations in order."""
    p = _authored(spark, d).withColumn("key", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")))
    who = F.transform(F.coalesce("who", F.array().cast("array<struct<position: int, author_id: string, name: string, orcid: string, orgs: array<struct<org_id: string, name: string, ror: string, country: string>>>>")),
                      lambda w: P.author(w["name"], w["orcid"], w["author_id"], F.transform(w["orgs"], lambda o: P.affiliation(o["name"], o["ror"], o["country"]))))
    out = M.merge_authors(p.select("key", "ord", "source", who.alias("authors")), "key")
    return out.select("key", "author_id", "name", "orcid", F.array_join("source_ids", "|").alias("source_ids"), F.array_join(F.transform("affiliations", lambda o: o["org_id"]), "|").alias("affiliations"))


QUERIES = {
    "q_cache_first": cache_first, "q_persist_resolved": persist_resolved, "q_entry_upsert": entry_upsert, "q_reconciled": reconciled, "q_delete_papers": delete_papers, "q_rank_all": rank_all,
    "q_openalex_records": openalex_records, "q_openalex_authors": openalex_authors, "q_arxiv_rows": arxiv_rows, "q_crossref_records": crossref_records, "q_semantic_records": semantic_records, "q_merge_authors": merge_authors,
}

_NEWEST = "ORDER BY coalesce(updated_at, TIMESTAMP '0001-01-01') DESC, id"
_PAPERS = f"SELECT id, coalesce(title, '') AS title, coalesce(doi, '') AS doi, coalesce(arxiv_id, '') AS arxiv_id, updated_at FROM papers"
CACHED = f"""p AS ({_PAPERS}), pk AS (SELECT id, updated_at, {s_doi('doi')} AS qd, CASE WHEN {s_arxiv('arxiv_id')} <> '' THEN {s_arxiv('arxiv_id')} ELSE {s_alias('doi')} END AS qa, {s_title('title')} AS qt FROM p),
ka AS (SELECT qa, id AS pa FROM (SELECT *, row_number() OVER (PARTITION BY qa {_NEWEST}) AS n FROM pk WHERE qa <> '') WHERE n = 1),
kd AS (SELECT qd, id AS pd FROM (SELECT *, row_number() OVER (PARTITION BY qd {_NEWEST}) AS n FROM pk WHERE qd <> '') WHERE n = 1),
kt AS (SELECT qt, min(id) AS pt FROM pk WHERE qt <> '' GROUP BY 1 HAVING count(*) = 1),
eff AS ({_EFF}), hit AS (SELECT qid, CASE WHEN pa IS NOT NULL THEN 'arxiv' WHEN pd IS NOT NULL THEN 'doi' WHEN pt IS NOT NULL THEN 'title' ELSE 'miss' END AS found_by, coalesce(pa, pd, pt, '') AS paper
  FROM eff LEFT JOIN ka ON eff_arxiv = ka.qa LEFT JOIN kd ON eff_doi = kd.qd LEFT JOIN kt ON tn = kt.qt)"""
_PLACE = "coalesce(nullif(list_position([" + ", ".join(f"'{s}'" for s in SOURCES) + f"], source), 0), {len(SOURCES) + 1})"


def _merged(name: str, rows: str) -> str:
    return f"""{name}_k AS ({rows}), {name}_g AS (SELECT mode, value, coalesce(min(nullif({s_doi('doi')}, '')), '') AS doi, coalesce(min(nullif({s_arxiv('arxiv_id')}, '')), '') AS arxiv_id, coalesce(min(nullif(trim(year, ' '), '')), '') AS year,
  max((trim(abstract, ' ') <> '')::INT) AS has_abstract, max(len(keywords) + len(categories)) AS n_terms FROM {name}_k GROUP BY 1, 2),
{name}_b AS (SELECT mode, value, title, venue FROM (SELECT *, row_number() OVER (PARTITION BY mode, value ORDER BY (doi <> '')::INT DESC, (arxiv_id <> '')::INT DESC, score DESC, length(title) DESC, ord) AS rn FROM {name}_k) WHERE rn = 1),
{name} AS (SELECT g.*, b.title, b.venue, {s_paper_id('g.doi', 'g.arxiv_id', 'b.title', 'g.year')} AS paper_id FROM {name}_g g JOIN {name}_b b USING (mode, value))"""


_BYLINE = "SELECT paper_id, author_id, min(position) AS position FROM paper_authors GROUP BY 1, 2"
_PAP, _AUT = "concat('pap', lpad(CAST(qid AS VARCHAR), 9, '0'))", "concat('aut', lpad(CAST(qid AS VARCHAR), 8, '0'))"
_ORCID = r"regexp_replace(lower(trim(coalesce(orcid, ''), ' ')), '^(?:https?://orcid\.org/|orcid:)', '')"
_WHO = f"""SELECT b.paper_id AS id, row_number() OVER (PARTITION BY b.paper_id ORDER BY coalesce(b.position, 1000000), b.author_id) - 1 AS place, a.id AS author, trim(coalesce(a.name, ''), ' ') AS name, {_ORCID} AS orcid FROM ({_BYLINE}) b JOIN authors a ON b.author_id = a.id"""
_ORGS = """SELECT author_id, id AS org_id, trim(coalesce(name, ''), ' ') AS name, trim(coalesce(ror, ''), ' ') AS ror, trim(coalesce(country, ''), ' ') AS country FROM (SELECT DISTINCT author_id, org_id FROM author_orgs) x JOIN orgs o ON x.org_id = o.id
WHERE trim(coalesce(name, ''), ' ') <> '' OR trim(coalesce(ror, ''), ' ') <> '' OR trim(coalesce(country, ''), ' ') <> ''"""


def _terms(x: str) -> str:
    t = f"list_filter(list_transform({x}, lambda y: {s_clean('y')}), lambda y: y <> '')"
    return f"array_to_string(list_slice(list_filter({t}, lambda z, i: list_position(list_transform({t}, lambda y: lower(y)), lower(z)) = i), 1, 12), '|')"


def _record_sql(source_id: str, year: str, doi: str, arxiv: str, url: str, categories: str, keywords: str, score: str, reason: str, where: str = "true", venue: str = "trim(venue, ' ')") -> str:
    return f"""SELECT {source_id} AS source_id, trim(title, ' ') AS title, {venue} AS venue, {year} AS year, {doi} AS doi, {arxiv} AS arxiv_id, {url} AS url, md5({s_clean('abstract')}) AS abstract_md5,
  {keywords} AS keywords, {categories} AS categories, coalesce(n, 0) AS n_authors, {score}::DOUBLE AS score, '{reason}' AS reason
FROM ({CANDIDATES}) c LEFT JOIN (SELECT id AS who_id, count(*) AS n FROM ({_WHO}) GROUP BY 1) w ON c.id = w.who_id WHERE {where}"""


_Y = "CASE WHEN regexp_matches(trim(year, ' '), '^[0-9]+$') THEN CAST(CAST(trim(year, ' ') AS INT) AS VARCHAR) ELSE '' END"
_ABS = "'https://arxiv.org/abs/' || " + s_arxiv("arxiv_id")
# records hold bare identifiers, of which the keys are taken as of any others
_RECORD_KEYS = f"""{s_doi('doi')} AS d, CASE WHEN {s_arxiv('arxiv_id')} <> '' THEN {s_arxiv('arxiv_id')} ELSE {s_alias('doi')} END AS a, {s_title('title')} AS t,
  CASE WHEN regexp_matches(trim(year, ' '), '^[0-9]+$') THEN trim(year, ' ') ELSE '' END AS y, {s_title('venue')} AS v"""
_NEW_KEYS = _KEYS.replace("CASE WHEN id <> '' THEN id END", "paper_id")

SQL = {
    "q_cache_first": f"""WITH {CACHED}, {_merged('fast', f"SELECT * FROM (SELECT *, {_PLACE} AS place, min({_PLACE}) OVER (PARTITION BY mode, value) AS least FROM ({_IDENT})) WHERE place = least")}, {_merged('whole', _IDENT)},
asked AS (SELECT qid, mode, CASE mode WHEN 'doi' THEN d WHEN 'arxiv' THEN a END AS value FROM (SELECT qid, eff_doi AS d, eff_arxiv AS a, CASE WHEN eff_doi <> '' THEN 'doi' WHEN eff_arxiv <> '' THEN 'arxiv' WHEN title <> '' THEN 'title' ELSE 'none' END AS mode FROM eff)),
r AS (SELECT a.qid, a.mode, h.paper, h.found_by, f.paper_id AS fast_id, w.paper_id AS whole_id,
  trim(f.title, ' ') <> '' AND (f.doi <> '' OR f.arxiv_id <> '') AND (regexp_matches(f.year, '^[0-9]+$') OR trim(f.venue, ' ') <> '') AND (f.has_abstract = 1 OR f.n_terms > 0) AS complete
  FROM asked a JOIN hit h USING (qid) LEFT JOIN fast f ON a.mode = f.mode AND a.value = f.value LEFT JOIN whole w ON a.mode = w.mode AND a.value = w.value)
SELECT qid, mode, CASE WHEN found_by <> 'miss' OR fast_id IS NOT NULL THEN 'resolved' ELSE 'not_found' END AS status,
  CASE WHEN found_by <> 'miss' THEN 'cache_hit' WHEN fast_id IS NOT NULL AND NOT complete THEN 'cache_miss_fast_incomplete_fallback_consensus' ELSE 'fast' END AS strategy,
  CASE WHEN found_by <> 'miss' THEN paper WHEN fast_id IS NULL THEN '' WHEN complete THEN fast_id ELSE whole_id END AS paper_id FROM r WHERE found_by <> 'miss' OR mode IN ('doi', 'arxiv')""",
    "q_persist_resolved": f"""WITH q AS (SELECT *, {_PAP} AS paper_id, {_AUT} AS author_id FROM ({REQUESTS})), w AS (SELECT q.qid, q.paper_id, q.author_id, a.name, a.orcid FROM q JOIN authors a ON q.author_id = a.id),
o AS (SELECT w.*, x.org_id, x.name AS org, x.ror, x.country FROM w JOIN (SELECT author_id, min(org_id) AS org_id FROM author_orgs JOIN orgs ON org_id = orgs.id GROUP BY 1) m ON w.author_id = m.author_id JOIN (SELECT id AS org_id, name, ror, country FROM orgs) x ON m.org_id = x.org_id),
b0 AS ({_BYLINE}), b AS (SELECT paper_id, author_id, CAST(position AS INT) AS position FROM b0 WHERE paper_id NOT IN (SELECT paper_id FROM q) UNION ALL SELECT paper_id, author_id, 0 FROM w),
n AS (SELECT author_id, count(DISTINCT paper_id) AS n FROM b GROUP BY 1),
gone AS (SELECT DISTINCT author_id FROM b0 WHERE paper_id IN (SELECT paper_id FROM q) AND author_id NOT IN (SELECT author_id FROM w) AND author_id NOT IN (SELECT author_id FROM n)),
rep AS (SELECT DISTINCT w.author_id FROM w LEFT JOIN n USING (author_id) WHERE coalesce(n.n, 0) <= 1 UNION SELECT author_id FROM gone),
kept AS (SELECT author_id, org_id, max(role) AS role FROM author_orgs WHERE author_id NOT IN (SELECT author_id FROM rep) GROUP BY 1, 2),
ao AS (SELECT * FROM kept UNION ALL SELECT DISTINCT author_id, org_id, NULL FROM o WHERE (author_id, org_id) NOT IN (SELECT (author_id, org_id) FROM kept)),
pr AS (SELECT id, entity_type FROM provenance UNION SELECT concat('paper::', paper_id, '::resolver::', CASE WHEN {s_doi('doi')} <> '' THEN {s_doi('doi')} WHEN {s_arxiv('arxiv_id')} <> '' THEN {s_arxiv('arxiv_id')} ELSE paper_id END), 'paper' FROM q
  UNION SELECT concat('author::', author_id, '::resolver::', CASE WHEN coalesce(orcid, '') <> '' THEN orcid ELSE author_id END), 'author' FROM w UNION SELECT concat('paper_author::', paper_id, '::', author_id, '::resolver::0'), 'paper_author' FROM w
  UNION SELECT concat('org::', org_id, '::resolver::', coalesce(nullif(ror, ''), nullif(org, ''), org_id)), 'org' FROM o UNION SELECT concat('author_org::', author_id, '::', org_id, '::resolver::', coalesce(nullif(ror, ''), nullif(org, ''), '')), 'author_org' FROM o
  UNION SELECT concat('paper::', paper_id, '::', source, '::', coalesce(nullif(source_id, ''), nullif(doi, ''), arxiv_id)), 'paper' FROM q WHERE source <> '')
SELECT 'papers' AS relation, coalesce(p.id, q.paper_id) AS key, CASE WHEN q.qid IS NOT NULL THEN concat_ws('|', md5(q.title), {s_doi('q.doi')}, {_Y.replace('year', 'q.year')}) ELSE concat_ws('|', md5(coalesce(p.title, '')), coalesce(p.doi, ''), coalesce(CAST(p.year AS VARCHAR), '')) END AS value FROM papers p FULL OUTER JOIN q ON p.id = q.paper_id
UNION ALL SELECT 'authors', id, coalesce(name, '') FROM authors UNION ALL SELECT 'orgs', id, coalesce(name, '') FROM orgs
UNION ALL SELECT 'bylines', concat_ws('|', paper_id, author_id), coalesce(CAST(position AS VARCHAR), '') FROM b
UNION ALL SELECT 'metadata', concat_ws('|', b.paper_id, b.author_id), CASE WHEN o.qid IS NOT NULL THEN '1' ELSE '0' END FROM b LEFT JOIN o ON b.paper_id = o.paper_id AND b.author_id = o.author_id
UNION ALL SELECT 'author_orgs', concat_ws('|', author_id, org_id), coalesce(role, '') FROM ao UNION ALL SELECT 'provenance', id, entity_type FROM pr""",
    "q_entry_upsert": f"""WITH r AS (SELECT qid, paper_id, title, CASE WHEN eff_doi <> '' THEN concat('doi:', eff_doi) WHEN eff_arxiv <> '' THEN concat('arxiv:', eff_arxiv) WHEN tn <> '' THEN concat('title:', tn) ELSE 'empty' END AS query_key, {_NEW_KEYS} AS paper_keys, qid % 5 AS n_sources
  FROM (SELECT *, concat('pap', lpad(CAST(qid // 2 AS VARCHAR), 9, '0')) AS paper_id FROM ({_EFF}))),
m AS (SELECT paper_id, arg_max(title, qid) AS title, min(qid) AS q0, max(n_sources) AS most FROM r GROUP BY 1),
k AS (SELECT paper_id, query_key AS k FROM r UNION SELECT r.paper_id, unnest(paper_keys) FROM r JOIN m USING (paper_id) WHERE qid > q0 OR r.paper_id IN (SELECT id FROM papers) UNION SELECT id, concat('id:', id) FROM papers),
l AS (SELECT paper_id, md5(string_agg(k, '|' ORDER BY k)) AS keys_md5 FROM k GROUP BY 1)
SELECT coalesce(p.id, m.paper_id) AS paper_id, md5(CASE WHEN m.paper_id IS NOT NULL THEN m.title ELSE coalesce(p.title, '') END) AS title_md5, l.keys_md5, greatest(CASE WHEN p.id IS NOT NULL THEN 2 ELSE 0 END, coalesce(m.most, 0)) AS source_count,
  CASE WHEN m.paper_id IS NOT NULL THEN 'cache_first' ELSE 'fast' END AS policy, CASE WHEN p.id IS NOT NULL THEN 't0' ELSE 't1' END AS first_seen, CASE WHEN m.paper_id IS NOT NULL THEN 't1' ELSE 't0' END AS last_seen
FROM papers p FULL OUTER JOIN m ON p.id = m.paper_id JOIN l ON l.paper_id = coalesce(p.id, m.paper_id)""",
    "q_reconciled": f"""WITH p0 AS (SELECT ord, id, {s_doi('doi')} AS doi, {s_arxiv('arxiv_id')} AS arxiv_id, title, year, venue FROM ({CANDIDATES})),
q0 AS (SELECT qid, {s_doi('doi')} AS doi, {s_arxiv('arxiv_id')} AS arxiv_id, title, year, venue, {s_paper_id(s_doi('doi'), s_arxiv('arxiv_id'), 'title', 'year')} AS own FROM ({REQUESTS})),
p AS (SELECT *, {_RECORD_KEYS} FROM p0), q AS (SELECT *, {_RECORD_KEYS} FROM q0),
m AS (SELECT qid, min(ord) AS ord FROM (SELECT qid, ord FROM q JOIN p ON q.d = p.d WHERE q.d <> '' UNION ALL SELECT qid, ord FROM q JOIN p ON q.a = p.a WHERE q.a <> ''
  UNION ALL SELECT qid, ord FROM q JOIN p ON q.t = p.t AND q.y = p.y WHERE q.t <> '' AND q.y <> '' AND (q.v = '' OR p.v = '' OR q.v = p.v)) GROUP BY 1)
SELECT q.qid, coalesce(p.id, q.own) AS paper_id, CASE WHEN q.doi <> '' THEN q.doi ELSE coalesce(p.doi, '') END AS doi, CASE WHEN q.arxiv_id <> '' THEN q.arxiv_id ELSE coalesce(p.arxiv_id, '') END AS arxiv_id FROM q LEFT JOIN m USING (qid) LEFT JOIN p USING (ord)""",
    "q_delete_papers": """WITH g AS (SELECT id FROM papers WHERE coalesce(title, '') = '')
SELECT 'papers' AS relation, id, count(*) AS n FROM papers WHERE id NOT IN (SELECT id FROM g) GROUP BY 2
UNION ALL SELECT 'bylines', paper_id, count(*) FROM paper_authors WHERE paper_id NOT IN (SELECT id FROM g) GROUP BY 2
UNION ALL SELECT 'metadata', paper_id, count(DISTINCT author_id) FROM paper_authors WHERE paper_id NOT IN (SELECT id FROM g) GROUP BY 2
UNION ALL SELECT 'provenance', concat(entity_type, ' ', entity_id), count(*) FROM provenance WHERE entity_type <> 'paper' OR entity_id NOT IN (SELECT id FROM g) GROUP BY 2
UNION ALL SELECT 'provenance', concat('paper_author ', paper_id, '::', author_id), 1 FROM (SELECT DISTINCT paper_id, author_id FROM paper_authors) WHERE paper_id NOT IN (SELECT id FROM g)""",
    "q_rank_all": f"""SELECT row_number() OVER (ORDER BY score DESC, (doi <> '')::INT DESC, (arxiv_id <> '')::INT DESC, length(title) DESC, first_ord) AS rank, key, id FROM
(SELECT *, min(ord) OVER (PARTITION BY key) AS first_ord, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS rn FROM (SELECT *, {s_paper_id(s_doi('doi'), s_arxiv('arxiv_id'), 'title', 'year')} AS key FROM ({CANDIDATES}))) WHERE rn = 1""",
    "q_openalex_records": _record_sql("id", _Y, s_doi("doi"), s_arxiv("arxiv_id"), "trim(url, ' ')", _terms("list_slice(categories, 1, 3)"), _terms("keywords"), "0.9", "lookup_arxiv"),
    "q_openalex_authors": f"""SELECT w.id, place, w.name, orcid, author, coalesce(o.l, '') AS affiliations FROM ({_WHO}) w LEFT JOIN (SELECT author_id, string_agg(concat_ws('/', name, ror, country), '; ' ORDER BY org_id) AS l FROM ({_ORGS}) GROUP BY 1) o ON w.author = o.author_id""",
    "q_arxiv_rows": _record_sql(f"trim({s_arxiv(_ABS)}, ' ')", r"regexp_extract(CASE WHEN regexp_matches(trim(year, ' '), '^[0-9]+$') THEN concat(trim(year, ' '), '-01') ELSE '-01' END, '^([0-9]{4})', 1)", "''",
                                s_arxiv(_ABS), f"trim({_ABS}, ' ')", _terms("categories"), _terms("categories"), "1.0", "lookup_arxiv", "arxiv_id <> ''", "'arXiv'"),
    "q_crossref_records": _record_sql("trim(doi, ' ')", _Y, s_doi("doi"), "''", "trim(url, ' ')", _terms("keywords"), _terms("keywords"), "1.0", "lookup_doi"),
    "q_semantic_records": _record_sql("id", _Y, s_doi("doi"), s_arxiv("arxiv_id"), "trim(url, ' ')", _terms("categories"), _terms("keywords"), "0.75", "search_title"),
    "q_merge_authors": f"""WITH r AS (SELECT {s_paper_id(s_doi('doi'), s_arxiv('arxiv_id'), 'title', 'year')} AS key, ord, CASE WHEN source <> '' THEN source ELSE 'unknown' END AS src, source, w.place, w.author, w.name, w.orcid FROM ({CANDIDATES}) c JOIN ({_WHO}) w ON c.id = w.id),
k AS (SELECT *, CASE WHEN orcid <> '' THEN concat('orcid:', orcid) ELSE concat(src, ':', author) END AS author_id FROM r),
h AS (SELECT key, author_id, coalesce(arg_min(name, (ord, place)) FILTER (name <> ''), '') AS name, coalesce(arg_min(orcid, (ord, place)) FILTER (orcid <> ''), '') AS orcid FROM k GROUP BY 1, 2),
i AS (SELECT key, author_id, string_agg(author, '|' ORDER BY fst) AS l FROM (SELECT key, author_id, author, min((ord, place)) AS fst FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2),
o AS (SELECT k.*, x.org_id AS org, x.name AS org_name, x.ror, x.country, CASE WHEN x.ror <> '' THEN concat('ror:', lower(x.ror)) ELSE concat('org:', k.source, ':', substr(sha1(concat(k.source, '|', lower(x.name))), 1, 16)) END AS oid,
  row_number() OVER (PARTITION BY k.key, k.author_id, k.ord, k.place ORDER BY x.org_id) AS pos FROM k JOIN ({_ORGS}) x ON k.author = x.author_id),
a AS (SELECT key, author_id, string_agg(oid, '|' ORDER BY fst) AS l FROM (SELECT key, author_id, oid, org_name, ror, country, min((ord, place, pos)) AS fst FROM o GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2)
SELECT h.key, h.author_id, h.name, h.orcid, coalesce(i.l, '') AS source_ids, coalesce(a.l, '') AS affiliations FROM h LEFT JOIN i USING (key, author_id) LEFT JOIN a USING (key, author_id)""",
}
