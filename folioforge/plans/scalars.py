"""Queries over the scalar builders: normal forms, keys, text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import records as R
from ..functions.digest import raw_row_key
from ..operators.resolve import with_lookup_ids
from .relations import CANDIDATES, PROMPTS, REQUESTS, candidates, prompts, requests, s_alias, s_arxiv, s_clean, s_dedup, s_doi, s_paper_id, s_shorten, s_title, table

c = F.col


def normalize_ids(spark, d):
    return candidates(spark, d).select("id", R.bare_doi(c("doi")).alias("doi_norm"), R.bare_arxiv(c("arxiv_id")).alias("arxiv_norm"), R.alias_arxiv(c("doi")).alias("alias"))


def normalize_title(spark, d):
    return candidates(spark, d).select("id", R.title_words(c("title")).alias("title_norm"), R.title_words(c("venue")).alias("venue_norm"), R.digits_or_empty(c("year")).alias("year_norm"))


def query_keys(spark, d):
    q = with_lookup_ids(requests(spark, d)).withColumn("tn", R.title_words(c("title")))
    key = F.when(c("eff_doi") != "", F.concat(F.lit("doi:"), "eff_doi")).when(c("eff_arxiv") != "", F.concat(F.lit("arxiv:"), "eff_arxiv")).when(c("tn") != "", F.concat(F.lit("title:"), "tn")).otherwise("empty")
    mode = F.when(c("eff_doi") != "", "doi").when(c("eff_arxiv") != "", "arxiv").when(c("title") != "", "title").otherwise("none")
    return q.select("qid", "eff_doi", "eff_arxiv", key.alias("query_key"), mode.alias("mode"), F.array_join(R.input_warnings(c("doi"), c("arxiv_url")), ",").alias("warnings"))


def paper_ids(spark, d):
    return candidates(spark, d).select("id", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")).alias("paper_id"), R.loose_key(c("doi"), c("arxiv_id"), c("title"), c("year")).alias("candidate_key"))


def org_ids(spark, d):
    return table(spark, d, "orgs").select("id", R.org_id(c("name"), c("ror"), F.lit("kb")).alias("org_id"))


def author_ids(spark, d):
    names = (
        table(spark, d, "author_orgs").join(table(spark, d, "orgs").select(c("id").alias("org_id"), c("name").alias("org")), "org_id")
        .groupBy(c("author_id").alias("id")).agg(F.collect_set("org").alias("orgs"))
    )
    a = table(spark, d, "authors").join(names, "id", "left")
    none = F.array().cast("array<string>")
    return a.select("id", R.author_id(c("name"), c("orcid"), F.lit(""), F.lit("kb"), F.coalesce("orgs", none)).alias("author_id"))


def row_keys(spark, d):
    q = requests(spark, d)
    return q.select(
        "qid", R.fallback_key(c("source"), c("source_id"), c("title"), c("year"), c("doi"), c("arxiv_id"), c("url")).alias("source_key"),
        R.cache_key(c("source"), c("source_id"), c("doi"), c("arxiv_id"), c("title"), c("year")).alias("cache_key"),
    )


def paper_key_sets(spark, d):
    bare = candidates(spark, d).select("id", R.bare_doi(c("doi")).alias("d"), R.bare_arxiv(c("arxiv_id")).alias("a"), R.title_words(c("title")).alias("t"))
    keyed = bare.withColumn("al", R.alias_arxiv(c("d"))).select("id", R.key_set(c("id"), c("d"), c("a"), c("al"), c("t")).alias("ks"))
    return keyed.select("id", F.array_join("ks", "|").alias("keys"), F.array_join(R.arxiv_of_keys(R.alias_keys(c("ks"))), "|").alias("arxiv_ids"))


def clean_text(spark, d):
    t = R.clean(c("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("clean_md5"), F.md5(R.shorten(t, 200)).alias("short_md5"), F.md5(R.shorten(t, 400, "...")).alias("memory_md5"))


def terms_distinct(spark, d):
    return candidates(spark, d).select("id", F.array_join(R.distinct_terms(F.concat("keywords", "categories")), "|").alias("terms"))


def inverted_abstract(spark, d):
    """Abstracts as token positions, as some services deliver them, and back in order."""
    words = candidates(spark, d).select("id", F.posexplode(F.split(R.clean(c("abstract")), " ")).alias("pos", "token"))
    inverted = words.groupBy("id", "token").agg(F.collect_list("pos").alias("positions"))
    pairs = inverted.select("id", F.transform("positions", lambda p: F.struct(p.alias("pos"), c("token").alias("token"))).alias("at"))
    whole = pairs.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("all"))
    return whole.select("id", F.md5(F.array_join(F.transform("all", lambda x: x["token"]), " ")).alias("abstract_md5"))


def prompt_signals(spark, d):
    p = prompts(spark, d).withColumns({"dois": R.found_dois(c("prompt")), "arxiv_ids": R.prompt_arxiv(c("prompt")), "hint": R.title_hint(c("prompt"))})
    known = (F.size("dois") > 0) | (F.size("arxiv_ids") > 0)
    return p.select("qid", F.array_join("dois", "|").alias("dois"), F.array_join("arxiv_ids", "|").alias("arxiv_ids"), "hint", R.plan_template(c("prompt"), known).alias("template"))


def query_seed(spark, d):
    p = prompts(spark, d).withColumns({"known": F.concat(R.found_dois(c("prompt")), R.prompt_arxiv(c("prompt"))), "hint": R.title_hint(c("prompt"))})
    p = p.withColumn("seed", R.bare_seed(c("prompt"), c("known")))
    return p.select("qid", R.seed_or_hint(c("seed"), c("hint"), c("prompt")).alias("seed"))


def text_identifiers(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", F.array_join(R.found_dois(c("text")), "|").alias("dois"), F.array_join(R.found_arxiv(c("text")), "|").alias("arxiv_ids"))


def complete_records(spark, d):
    n = table(spark, d, "paper_authors").groupBy(c("paper_id").alias("id")).agg(F.countDistinct("author_id").alias("n"))
    p = candidates(spark, d).join(n, "id", "left")
    ok = R.is_complete(c("title"), c("doi"), c("arxiv_id"), c("year"), c("venue"), c("abstract"), F.size("keywords") + F.size("categories"), F.coalesce("n", F.lit(0)))
    return p.select("id", ok.cast("int").alias("complete"))


def target_pages(spark, d):
    q = requests(spark, d)
    # the first pages of each source in order; the place is limited before the shuffle, so a large source is no burden
    hit = R.is_target(c("url"), F.lit("scholar_graph")) | R.host_of(c("url")).endswith(".example")
    place = F.row_number().over(W.partitionBy("source").orderBy("qid"))
    return q.where(hit).withColumn("fetched", place).where("fetched <= 3").select("qid", R.host_of(c("url")).alias("host"), c("fetched").cast("long").alias("fetched"))


def pipe_lists(spark, d):
    """Lists to text joined by pipes and back, blanks dropped."""
    text = F.array_join(F.filter("keywords", lambda k: F.trim(k) != ""), "|")
    return candidates(spark, d).select("id", text.alias("joined"), F.size(F.filter(F.split(text, r"\|"), lambda k: k != "")).cast("long").alias("n"))


def venue_year_filter(spark, d):
    """Rows in the years asked for; a venue not asked for is out, but a missing one passes."""
    asked = ("journal of municipal and narrative informatics", "symposium on seasonal and neotropical measurement", "")
    y = R.digits_or_empty(c("year"))
    return candidates(spark, d).where(F.lower(F.trim("venue")).isin(*asked)).where((y != "") & y.cast("int").between(2015, 2024)).select("id", "venue", "year")


def raw_row_keys(spark, d):
    q = requests(spark, d)
    return q.select("qid", raw_row_key(c("source"), c("source_id"), c("title"), c("year"), c("doi"), c("arxiv_id"), c("url")).alias("row_key"))


QUERIES = {
    "q_raw_row_keys": raw_row_keys, "q_normalize_ids": normalize_ids, "q_normalize_title": normalize_title, "q_query_keys": query_keys, "q_stable_paper_ids": paper_ids, "q_stable_org_ids": org_ids,
    "q_stable_author_ids": author_ids, "q_row_keys": row_keys, "q_paper_key_sets": paper_key_sets, "q_clean_text": clean_text, "q_terms_distinct": terms_distinct,
    "q_inverted_abstract": inverted_abstract, "q_prompt_signals": prompt_signals, "q_query_seed": query_seed, "q_text_identifiers": text_identifiers,
    "q_complete_records": complete_records, "q_target_pages": target_pages, "q_pipe_lists": pipe_lists, "q_venue_year_filter": venue_year_filter,
}

_ALIAS, _DOI = s_alias("doi"), s_doi("doi")
_GIVEN = f"(CASE WHEN arxiv_id <> '' THEN {s_arxiv('arxiv_id')} ELSE {s_arxiv('arxiv_url')} END)"
_EFF = f"SELECT *, CASE WHEN {_ALIAS} <> '' THEN '' ELSE {_DOI} END AS eff_doi, CASE WHEN {_GIVEN} <> '' THEN {_GIVEN} ELSE {_ALIAS} END AS eff_arxiv, {s_title('title')} AS tn FROM ({REQUESTS})"
_SOURCE = "lower(trim(CASE WHEN source <> '' THEN source ELSE 'unknown' END, ' '))"
_DOIS_IN = r"list_filter(list_transform(regexp_extract_all({c}, '(10\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+)', 1), lambda x: " + s_doi(r"regexp_replace(x, '[.,);\]]+$', '')") .replace("{", "{{").replace("}", "}}") + "), lambda x: x <> '')"
_ARXIV_IN = r"list_filter(list_transform(regexp_extract_all({c}, '\b([0-9]{{4}}\.[0-9]{{4,5}}(?:v[0-9]+)?)\b', 1), lambda x: " + s_arxiv("x").replace("{", "{{").replace("}", "}}") + "), lambda x: x <> '')"
_URLS_IN = r"list_transform(regexp_extract_all({c}, '(?i)(https?://arxiv\.org/(?:abs|pdf)/[^\s]+)', 1), lambda x: " + s_arxiv("x").replace("{", "{{").replace("}", "}}") + ")"


def _first_seen(lst: str) -> str:
    """Distinct items of a list in the order of their first place."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


_P_DOIS, _P_ARXIV = _DOIS_IN.format(c="prompt"), f"list_filter(list_concat({_URLS_IN.format(c='prompt')}, {_ARXIV_IN.format(c='prompt')}), lambda x: x <> '')"
_SIGNALS = rf"""SELECT qid, prompt, {_first_seen('d0')} AS dois, {_first_seen('a0')} AS arxiv_ids, trim(regexp_extract(prompt, '"([^"]{{8,220}})"', 1), ' ') AS hint
FROM (SELECT qid, prompt, {_P_DOIS} AS d0, {_P_ARXIV} AS a0 FROM ({PROMPTS}))"""


def _any(col: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{t}')" for t in terms) + ")"


_TEMPLATE = f"""CASE WHEN len(dois) > 0 OR len(arxiv_ids) > 0 THEN 'identifier_targeted'
WHEN {_any('prompt', 'dblp', 'bibliography', 'proceedings', 'acm dl')} THEN 'bibliography_index'
WHEN {_any('prompt', 'google scholar', 'cited by', 'citation', 'related work')} THEN 'scholar_graph'
WHEN {_any('prompt', 'conference', 'program', 'accepted papers', 'track')} THEN 'conference_program_first'
WHEN {_any('prompt', 'latest', 'recent', 'top', 'papers on', 'paper on', 'theme', 'survey', 'state of the art')} THEN 'conference_program_first' ELSE 'mixed_theme' END"""

_KEYS = f"""list_sort(list_distinct(list_filter([CASE WHEN id <> '' THEN id END,
 CASE WHEN {_DOI} <> '' THEN concat('doi:', {_DOI}) END, CASE WHEN {s_arxiv('arxiv_id')} <> '' THEN concat('arxiv:', {s_arxiv('arxiv_id')}) END,
 CASE WHEN {s_arxiv('arxiv_id')} <> '' THEN concat('doi:10.48550/arxiv.', {s_arxiv('arxiv_id')}) END, CASE WHEN {_ALIAS} <> '' THEN concat('arxiv:', {_ALIAS}) END,
 CASE WHEN {_ALIAS} <> '' THEN concat('doi:10.48550/arxiv.', {_ALIAS}) END, CASE WHEN {s_title('title')} <> '' THEN concat('title:', {s_title('title')}) END], lambda x: x IS NOT NULL)))"""

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_TERMS = f"list_filter(list_transform(list_concat(keywords, categories), lambda x: {s_clean('x')}), lambda x: x <> '')"

SQL = {
    "q_normalize_ids": f"SELECT id, {_DOI} AS doi_norm, {s_arxiv('arxiv_id')} AS arxiv_norm, {_ALIAS} AS alias FROM ({CANDIDATES})",
    "q_normalize_title": f"SELECT id, {s_title('title')} AS title_norm, {s_title('venue')} AS venue_norm, CASE WHEN regexp_matches(trim(year), '^[0-9]+$') THEN trim(year) ELSE '' END AS year_norm FROM ({CANDIDATES})",
    "q_query_keys": f"""SELECT qid, eff_doi, eff_arxiv,
  CASE WHEN eff_doi <> '' THEN concat('doi:', eff_doi) WHEN eff_arxiv <> '' THEN concat('arxiv:', eff_arxiv) WHEN tn <> '' THEN concat('title:', tn) ELSE 'empty' END AS query_key,
  CASE WHEN eff_doi <> '' THEN 'doi' WHEN eff_arxiv <> '' THEN 'arxiv' WHEN title <> '' THEN 'title' ELSE 'none' END AS mode,
  array_to_string(list_filter([CASE WHEN contains({_DOI}, 'arxiv.org/') THEN 'doi_argument_looks_like_arxiv_url' END,
    CASE WHEN contains(lower(arxiv_url), 'doi.org/') THEN 'arxiv_url_argument_looks_like_doi_url' END,
    CASE WHEN {_DOI} <> '' AND NOT starts_with({_DOI}, '10.') THEN 'doi_argument_not_normalized' END,
    CASE WHEN {s_alias(_DOI)} <> '' THEN 'doi_argument_is_arxiv_doi_alias' END], lambda x: x IS NOT NULL), ',') AS warnings FROM ({_EFF})""",
    "q_stable_paper_ids": f"""SELECT id, {s_dedup()} AS paper_id, CASE WHEN lower(trim(doi, ' ')) <> '' THEN concat('doi:', lower(trim(doi, ' '))) WHEN lower(trim(arxiv_id, ' ')) <> '' THEN concat('arxiv:', lower(trim(arxiv_id, ' ')))
  ELSE concat('title:', lower(trim(title, ' ')), ':', trim(year, ' ')) END AS candidate_key FROM ({CANDIDATES})""",
    "q_stable_org_ids": "SELECT id, CASE WHEN coalesce(ror, '') <> '' THEN concat('ror:', lower(ror)) ELSE concat('org:kb:', substr(sha1(concat('kb|', lower(trim(coalesce(name, ''), ' ')))), 1, 16)) END AS org_id FROM orgs",
    "q_stable_author_ids": """WITH n AS (SELECT ao.author_id AS id, array_to_string(list_sort(list_distinct(list(lower(trim(o.name, ' ')) ) FILTER (coalesce(o.name, '') <> ''))), '|') AS names
  FROM author_orgs ao JOIN orgs o ON ao.org_id = o.id GROUP BY 1)
SELECT a.id, CASE WHEN coalesce(a.orcid, '') <> '' THEN concat('orcid:', lower(a.orcid)) ELSE concat('author:kb:', substr(sha1(concat('kb|', lower(trim(coalesce(a.name, ''), ' ')), '|', coalesce(n.names, ''))), 1, 16)) END AS author_id
FROM authors a LEFT JOIN n ON a.id = n.id""",
    "q_row_keys": f"""SELECT qid, CASE WHEN trim(source_id, ' ') <> '' THEN concat({_SOURCE}, ':', trim(source_id, ' ')) ELSE concat({_SOURCE}, ':fallback:', substr(sha1(concat_ws('|', {_SOURCE}, title, year, doi, arxiv_id, url)), 1, 16)) END AS source_key,
  CASE WHEN trim(source_id, ' ') <> '' THEN concat({_SOURCE}, ':', trim(source_id, ' ')) WHEN lower(trim(doi, ' ')) <> '' THEN concat({_SOURCE}, ':doi:', lower(trim(doi, ' ')))
  WHEN lower(trim(arxiv_id, ' ')) <> '' THEN concat({_SOURCE}, ':arxiv:', lower(trim(arxiv_id, ' '))) ELSE concat({_SOURCE}, ':title:', {s_title('title')}, ':', year) END AS cache_key FROM ({REQUESTS})""",
    "q_paper_key_sets": f"""SELECT id, array_to_string(ks, '|') AS keys, array_to_string(list_sort(list_distinct(list_filter(list_concat(list_transform(list_filter(ks, lambda x: starts_with(lower(x), 'arxiv:')), lambda x: substr(lower(x), 7)), list_transform(list_filter(ks, lambda x: starts_with(x, 'doi:10.48550/arxiv.')), lambda x: {s_arxiv('substr(x, 20)')})), lambda x: x <> ''))), '|') AS arxiv_ids
FROM (SELECT id, {_KEYS} AS ks FROM ({CANDIDATES}))""",
    "q_clean_text": f"SELECT doc_id, md5(t) AS clean_md5, md5({s_shorten('t', 200, '…')}) AS short_md5, md5({s_shorten('t', 400, '...')}) AS memory_md5 FROM (SELECT doc_id, {s_clean('text')} AS t FROM documents)",
    "q_terms_distinct": f"SELECT id, array_to_string(list_slice(list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i), 1, 12), '|') AS terms FROM (SELECT id, {_TERMS} AS t FROM ({CANDIDATES}))",
    "q_inverted_abstract": f"SELECT id, md5({s_clean('abstract')}) AS abstract_md5 FROM ({CANDIDATES})",
    "q_prompt_signals": f"SELECT qid, array_to_string(dois, '|') AS dois, array_to_string(arxiv_ids, '|') AS arxiv_ids, hint, {_TEMPLATE} AS template FROM ({_SIGNALS})",
    "q_text_identifiers": f"SELECT doc_id, array_to_string({_first_seen('d0')}, '|') AS dois, array_to_string({_first_seen('a0')}, '|') AS arxiv_ids FROM (SELECT doc_id, {_DOIS_IN.format(c='t')} AS d0, {_ARXIV_IN.format(c='t')} AS a0 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "q_complete_records": f"""SELECT c.id, CAST(trim(title) <> '' AND ({_DOI} <> '' OR {s_arxiv('arxiv_id')} <> '') AND (regexp_matches(trim(year), '^[0-9]+$') OR trim(venue) <> '')
  AND (trim(abstract) <> '' OR len(keywords) + len(categories) > 0 OR coalesce(n.n, 0) > 0) AS INT) AS complete
FROM ({CANDIDATES}) c LEFT JOIN (SELECT paper_id, count(DISTINCT author_id) AS n FROM paper_authors GROUP BY 1) n ON c.id = n.paper_id""",
    "q_target_pages": f"SELECT qid, host, fetched FROM (SELECT qid, {_HOST} AS host, row_number() OVER (PARTITION BY source ORDER BY qid) AS fetched FROM ({REQUESTS}) WHERE {_HOST} LIKE '%.example') WHERE fetched <= 3",
    "q_pipe_lists": f"SELECT id, array_to_string(list_filter(keywords, lambda x: trim(x) <> ''), '|') AS joined, CAST(len(list_filter(keywords, lambda x: trim(x) <> '')) AS BIGINT) AS n FROM ({CANDIDATES})",
    "q_venue_year_filter": f"""SELECT id, venue, year FROM ({CANDIDATES}) WHERE lower(trim(venue, ' ')) IN ('journal of municipal and narrative informatics', 'symposium on seasonal and neotropical measurement', '')
  AND regexp_matches(year, '^[0-9]+$') AND CAST(year AS INT) BETWEEN 2015 AND 2024""",
    "q_query_seed": rf"""WITH s AS ({_SIGNALS}),
a AS (SELECT *, list_reduce(list_prepend(trim(prompt, ' '), list_concat(dois, arxiv_ids)), lambda acc, x: regexp_replace(acc, concat('(?i)\Q', x, '\E'), ' ', 'g')) AS s0 FROM s),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s0, '(?i)https?://arxiv\.org/(?:abs|pdf)/\S+', ' ', 'g'), '(?i)https?://doi\.org/\S+', ' ', 'g'), '(?i)\bdoi\b', ' ', 'g'), '(?i)\barxiv\b', ' ', 'g') AS s1 FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(s1, '(?i)^(?:find details for |details for |find |show me |give me )\s*', ''), '(?i)^(?:latest papers? on |papers? on |find papers on |search papers on )\s*', '') AS s2 FROM b),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s2, '(?i)from top ai conferences|top ai conferences', ' ', 'g'), '(?i)latest ', ' ', 'g'), '(?i)recent ', ' ', 'g'), '(?i)\bfor and\b', ' ', 'g'), '(?i)\band related work\b', ' related work', 'g') AS s3 FROM c),
f AS (SELECT *, trim(regexp_replace(s3, '\s+', ' ', 'g'), ' ') AS s4 FROM e),
g AS (SELECT *, CASE WHEN len(regexp_extract_all(lower(s4), '[a-z0-9]{{3,}}')) <= 1 AND hint <> '' THEN hint ELSE s4 END AS s5 FROM f)
SELECT qid, CASE WHEN s5 <> '' THEN s5 ELSE trim(prompt, ' ') END AS seed FROM g""",
}
