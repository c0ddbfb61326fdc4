"""Queries of the search loop: plans, seeds, scores, decisions, resolution, the index, extraction."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import merge as M
from ..operators import resolve as S
from ..operators.session import finalized, run_sessions, status
from ..operators.components import connected_components, star_edges
from .relations import CANDIDATES, PROMPTS, REQUESTS, candidates, prompts, requests, s_alias, s_arxiv, s_clean, s_dedup, s_doi, s_paper_id, s_shorten, s_title, table
from .scalars import SQL as SCALAR_SQL
from .scalars import _ARXIV_IN, _DOIS_IN, _SIGNALS, _TEMPLATE, _first_seen

c = F.col
SOURCES = ["xref", "preprints", "openindex", "scholargraph"]


def plan_items(spark, d):
    """Searches planned for each prompt: the prompt itself, as a research paper, on arXiv; repeats and blanks left out."""
    base = F.trim("prompt")
    items = F.filter(F.array(base, F.concat(base, F.lit(" research paper")), F.concat(base, F.lit(" arxiv"))), lambda q: F.trim(q) != "")
    return prompts(spark, d).select("qid", F.posexplode(F.array_distinct(items)).alias("pos", "query")).select("qid", c("pos").cast("long").alias("pos"), F.trim("query").alias("query"))


# What each template plans around the compact seed: text before and after it, scope, intent.
PLANS = {
    "identifier_targeted": [("", "", "scholarly", "identifier_lookup_support")],
    "conference_program_first": [("", " accepted papers top AI conferences", "web", "conference_program_seed"), ("", " NeurIPS ICLR ICML program", "web", "conference_program_targeted"), ("", " research paper", "scholarly", "scholarly_confirmation")],
    "scholar_graph": [("", " related work", "scholarly", "graph_seed"), ("", " Google Scholar related articles", "web", "scholar_web_bridge")],
    "bibliography_index": [("site:dblp.org ", "", "web", "dblp_index_lookup"), ("", " bibliography", "scholarly", "scholarly_bibliography_lookup")],
    "mixed_theme": [("", "", "scholarly", "maximize_recall"), ("", " research paper", "scholarly", "maximize_recall"), ("", " arxiv", "scholarly", "maximize_recall")],
}


def _planned(spark, d, cycle):
    """qid, template, seed of a cycle; the best candidate before it is taken to be the paper that the request names."""
    p = prompts(spark, d).withColumns({"dois": R.found_dois(c("prompt")), "ids": R.prompt_arxiv(c("prompt")), "hint": R.title_hint(c("prompt"))})
    p = p.withColumn("bare", R.bare_seed(c("prompt"), F.concat("dois", "ids")))
    p = p.withColumns({"template": R.plan_template(c("prompt"), (F.size("dois") > 0) | (F.size("ids") > 0)), "seed": R.seed_or_hint(c("bare"), c("hint"), c("prompt"))})
    p = p.join(requests(spark, d).select("qid", c("title").alias("best")), "qid")
    n = F.lit(cycle)
    seed = F.trim(F.regexp_replace(R.cycle_seed(c("seed"), n, c("best")), r"\s+", " "))
    return p.select("qid", R.cycle_template(c("template"), n, c("best")).alias("template"), seed.alias("seed"))


def _steps(spark, planned):
    literal = spark.createDataFrame([(t, i, *x) for t, xs in PLANS.items() for i, x in enumerate(xs, 1)], "template string, step long, pre string, post string, scope string, intent string")
    plan = planned.where("seed != ''").join(F.broadcast(literal), "template")  # a dozen rows, whatever the data
    return plan.select("qid", "template", "step", F.concat("pre", "seed", "post").alias("query"), "scope", "intent")


def template_plans(spark, d):
    """What the first cycle of each prompt searches for, around its seed."""
    return _steps(spark, _planned(spark, d, 1))


def cycle_plans(spark, d):
    """The same of a later cycle, which goes on from the best candidate."""
    return _steps(spark, _planned(spark, d, 2))


def deterministic_rows(spark, d):
    """Records found by identifier as candidates, scored above all others."""
    out = S.resolve(requests(spark, d), candidates(spark, d), "consensus", SOURCES).where("status = 'resolved'")
    return out.select("qid", F.lit("deterministic").alias("source"), c("paper_id").alias("source_id"), "title", "doi", "arxiv_id", F.lit(1.2).alias("score"), F.lit("deterministic_resolved").alias("reason"))


def router_fallbacks(spark, d):
    """The ways of each prompt's plan when it ranks too few rows: made-up counts and settings by the prompt's number."""
    t = template_plans(spark, d).groupBy("qid", "template").agg(F.max(c("scope") == "web").alias("web"), F.max(c("scope") == "scholarly").alias("scholarly"))
    provider = F.when(c("qid") % 5 == 0, "other").otherwise("searxng")
    return t.select("qid", R.router_label(c("template"), c("web"), c("scholarly"), c("qid") % 2 == 0, c("qid") % 3 != 0, provider, c("qid") % 4).alias("router"))


def session_status(spark, d):
    """Where sessions stand: a session is a user, its ledger the decisions after each day."""
    ledger = cycle_decisions(spark, d).select(c("user_id").alias("session"), c("cycle").cast("int").alias("cycle"), F.lit("").alias("query"), F.array().cast("array<string>").alias("keys"), "move", "reason")
    stopped = finalized(ledger, ledger.where("session % 2 = 0").select("session").distinct())
    return status(stopped).select("session", c("cycle").cast("long").alias("cycle"), "status", "stop_reason")


def deterministic_queries(spark, d):
    p = prompts(spark, d)
    p = p.select("qid", R.found_dois(c("prompt")).alias("dois"), R.prompt_arxiv(c("prompt")).alias("ids"), R.title_hint(c("prompt")).alias("hint"))
    q = lambda kind, v, policy: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(policy).alias("policy"))
    ids = F.concat(F.transform("dois", lambda x: q("doi", x, "fast")), F.transform("ids", lambda x: q("arxiv_id", x, "fast")))
    items = F.when(F.size(ids) > 0, ids).when(c("hint") != "", F.array(q("title", c("hint"), "consensus")))
    return p.select("qid", F.explode(items).alias("x")).select("qid", "x.*")


def seed_queries(spark, d):
    """Seeds of each candidate in order: its DOI, its arXiv id, its title, identifiers in its text; each once."""
    doi, aid = R.bare_doi(c("doi")), R.bare_arxiv(c("arxiv_id"))
    body = F.concat_ws(" ", "title", "url", "abstract")
    tag = lambda p, v: F.when(v != "", F.concat(F.lit(p), v))
    seeds = F.array_distinct(F.array_compact(F.concat(
        F.array(tag("doi:", doi), tag("arxiv:", aid), tag("title:", F.trim("title"))),
        F.transform(R.found_dois(body), lambda x: F.concat(F.lit("doi:"), x)), F.transform(R.found_arxiv(body), lambda x: F.concat(F.lit("arxiv:"), x)),
    )))
    return candidates(spark, d).select("id", F.posexplode(seeds).alias("pos", "seed")).select("id", c("pos").cast("long").alias("pos"), F.md5("seed").alias("seed_md5"))


def seed_budget(spark, d):
    """The first 240 different seeds in the order of ranked candidates."""
    rows = candidates(spark, d).withColumn("key", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year")))
    top = M.top_candidates(rows, 240)
    tag = lambda p, v: F.when(v != "", F.concat(F.lit(p), v))
    seeds = F.array_compact(F.array(tag("doi:", R.bare_doi(c("doi"))), tag("arxiv:", R.bare_arxiv(c("arxiv_id"))), tag("title:", F.trim("title"))))
    first = top.select("rank", F.posexplode(seeds).alias("pos", "seed")).groupBy("seed").agg(F.min(F.struct("rank", "pos")).alias("at"))
    place = F.row_number().over(W.orderBy("at.rank", "at.pos"))
    return first.withColumn("place", place.cast("long")).where("place <= 240").select("place", F.md5("seed").alias("seed_md5"))


def fit_scores(spark, d):
    """How well candidates fit the prompts whose title they share; each prompt has one, so those that just miss are kept as raw fits."""
    q = requests(spark, d).select("qid", R.title_words(c("title")).alias("t"), c("title").alias("asked")).where("t != ''")
    best = candidates(spark, d).withColumn("t", R.title_words(c("title"))).groupBy("t").agg(F.min_by(F.struct("id", "title", "abstract", "venue", "keywords", "categories", "doi", "arxiv_id"), "ord").alias("r"))
    x = q.join(best, "t").select("qid", "asked", "r.*")
    target = F.concat_ws(" ", "title", "abstract", "venue", F.array_join("keywords", " "), F.array_join("categories", " "))
    x = x.withColumn("overlap", R.fit_overlap(c("asked"), target))
    score = R.fit_score(c("asked"), c("overlap"), R.has(c("doi")) | R.has(c("arxiv_id")))
    reason = F.when(F.size("overlap") > 0, F.concat(F.lit("overlap="), F.array_join(F.slice("overlap", 1, 6), ","))).otherwise("no_token_overlap")
    return x.select("qid", "id", F.round(score, 6).alias("fit"), reason.alias("reason"), R.fit_verdict(score, F.lit(False)).alias("verdict"))


def next_searches(spark, d):
    """Rows, identifiers and the next move of each search, here the words of each venue."""
    p = candidates(spark, d)
    n_ids = (R.bare_doi(c("doi")) != "").cast("int") + (R.bare_arxiv(c("arxiv_id")) != "").cast("int")
    stats = p.groupBy(R.title_words(c("venue")).alias("query")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(n_ids).cast("long").alias("n_ids"), F.max((F.trim("title") != "").cast("int")).alias("titled"))
    done = (c("n_rows") > 0) & ((c("n_ids") > 0) | (c("titled") > 0))
    return stats.withColumn("then", R.next_search(c("query"), done, c("n_ids"), c("n_rows"))).select("query", "n_rows", "n_ids", c("then.move").alias("move"), c("then.query").alias("next_query"))


def cycle_decisions(spark, d):
    """Decision after each cycle: a cycle is a day of a user's events, its candidates the types seen on it."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("keys"), F.count(F.lit(1)).alias("n"), F.count_if(c("value") < 5).alias("ignored"))
    w = W.partitionBy("user_id").orderBy("day")
    x = e.withColumns({"cycle": F.row_number().over(w), "before": F.lag("keys").over(w)})
    # a candidate list is empty when all events of the day are errors
    listed = F.size(F.array_remove("keys", "error"))
    out = R.cycle_decision(F.lit("theme_refine"), c("cycle"), F.lit(6), listed, c("ignored"), F.coalesce(c("keys") == c("before"), F.lit(False)))
    delta = F.size(F.array_except("keys", F.coalesce("before", F.array().cast("array<string>"))))
    return x.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), c("cycle").cast("long").alias("cycle"), delta.cast("long").alias("candidate_delta"), out["move"].alias("move"), out["reason"].alias("reason"))


def router_labels(spark, d):
    """Which ways each prompt's plan takes: web and then scholarly, one of them, or neither."""
    t = template_plans(spark, d).groupBy("qid").agg(F.max((c("scope") == "web").cast("int")).alias("web"), F.max((c("scope") == "scholarly").cast("int")).alias("sch"))
    return t.select("qid", F.when((c("web") == 1) & (c("sch") == 1), "web_then_scholarly").when(c("sch") == 1, "scholarly_only").when(c("web") == 1, "web_only").otherwise("mixed").alias("router"))


def _resolved(spark, d, policy):
    out = S.resolve(requests(spark, d), candidates(spark, d), policy, SOURCES)
    return out.select("qid", "mode", "status", R.text(c("paper_id")).alias("paper_id"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), R.text(c("title")).alias("title"), R.text(c("year")).alias("year"))


def resolve_consensus(spark, d):
    return _resolved(spark, d, "consensus")


def resolve_fast(spark, d):
    return _resolved(spark, d, "fast")


def resolve_titles(spark, d):
    """Requests without identifiers against the titles of papers."""
    q = S.lookups(requests(spark, d)).where("mode = 'title' and value != ''").select("qid", c("value").alias("title_norm"))
    p = candidates(spark, d).select("ord", R.title_words(c("title")).alias("title_norm"), "score", F.length("title").alias("title_len"))
    p = p.where("title_norm != ''").groupBy("title_norm").agg(F.max_by(F.struct("ord", "score", "title_len"), F.struct("score", "title_len", -c("ord"))).alias("r")).select("title_norm", "r.*")
    return S.resolve_titles(q, p)


def open_handoff(spark, d):
    """The twenty best candidates of each source and whether they can be looked up again."""
    rows = candidates(spark, d).withColumn("key", F.concat_ws("|", "source", R.dedup_key(c("doi"), c("arxiv_id"), c("title"), c("year"))))
    top = M.ranked(rows, within=["source"], most=20)
    ident = (R.bare_doi(c("doi")) != "") | (R.bare_arxiv(c("arxiv_id")) != "")
    return top.select("source", "rank", R.loose_key(c("doi"), c("arxiv_id"), c("title"), c("year")).alias("candidate_key"), F.when(ident, "resolved").otherwise("skipped").alias("status"), F.when(F.col("rank") <= 5, "1").otherwise("").alias("selected"))


def index_compact(spark, d):
    """Entries as the index keeps them: twelve authors, the number of all, abstracts of 1200 characters."""
    order = W.partitionBy("paper_id").orderBy("position", "author_id")
    a = table(spark, d, "paper_authors").groupBy("paper_id", "author_id").agg(F.min(F.coalesce("position", F.lit(10**9))).alias("position")).withColumn("n", F.row_number().over(order))
    short = a.groupBy(c("paper_id").alias("id")).agg(F.count(F.lit(1)).alias("author_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("n") <= 12, F.struct("n", "author_id")))), lambda x: x["author_id"]), ",").alias("authors"))
    p = candidates(spark, d).join(short, "id", "left")
    n = F.coalesce("author_count", F.lit(0)).cast("long")
    return p.select("id", F.md5(R.shorten(F.trim("abstract"), 1200)).alias("abstract_md5"), n.alias("author_count"), R.text(c("authors")).alias("authors"), F.greatest(F.lit(0), n - 12).cast("long").alias("truncated"))


def _author_counts(spark, d):
    return table(spark, d, "paper_authors").groupBy(c("paper_id").alias("id")).agg(F.countDistinct("author_id").alias("n_authors"))


def greedy_compaction(spark, d):
    """Index entries merged into the first earlier one that shares a key: DOI, arXiv id, their aliases, or title."""
    p = candidates(spark, d).join(_author_counts(spark, d), "id", "left")
    e = p.select(
        "ord", R.paper_keys(F.lit(""), c("doi"), c("arxiv_id"), c("title")).alias("keys"), F.lit(1).cast("long").alias("source_count"), c("id").alias("paper_id"), R.bare_arxiv(c("arxiv_id")).alias("arxiv_id"), R.bare_doi(c("doi")).alias("doi"),
        F.length("abstract").alias("abstract_chars"), F.coalesce("n_authors", F.lit(0)).cast("int").alias("author_count"), F.array(c("source")).alias("trace"), F.lpad(c("ord").cast("string"), 12, "0").alias("first_seen"), F.lpad(c("ord").cast("string"), 12, "0").alias("last_seen"), F.lit("fast").alias("policy"),
    ).where(F.size("keys") > 0)
    comp = connected_components(star_edges(e.select("ord", F.explode("keys").alias("k")), "k", "ord"))
    e = e.join(comp.withColumnRenamed("node", "ord"), "ord", "left").withColumn("component", F.coalesce("component", "ord"))
    out = S.compact_entries(e)
    return out.select("ord", "paper_id", "n_merged", F.size("keys").cast("long").alias("n_keys"), F.array_join("trace", "|").alias("trace"), "first_seen", "last_seen", F.array_join("removed", "|").alias("removed"))


def preferred_paper(spark, d):
    """Of the rows of a title the one to keep: that whose arXiv id a request of the title asks for, then by arXiv id, DOI, longer abstract, more authors; the earlier of equals."""
    p = candidates(spark, d).where("title != ''").withColumn("t", R.title_words(c("title"))).join(_author_counts(spark, d), "id", "left")
    q = requests(spark, d).select(R.title_words(c("title")).alias("t"), R.bare_arxiv(c("arxiv_id")).alias("a")).where("a != ''").groupBy("t").agg(F.collect_set("a").alias("asked"))
    p = p.join(q, "t", "left").withColumn("a", R.bare_arxiv(c("arxiv_id")))
    match = F.coalesce(F.array_contains("asked", c("a")), F.lit(False)).cast("int")
    order = F.struct(match, (c("a") != "").cast("int"), (R.bare_doi(c("doi")) != "").cast("int"), F.length("abstract"), F.coalesce("n_authors", F.lit(0)), -c("ord"))
    return p.groupBy("t").agg(F.max_by("id", order).alias("preferred"), F.count(F.lit(1)).alias("n"))


def page_hints(spark, d, pages=3, chars=600):
    """Identifiers that papers lack, filled in from the pages about them, and an excerpt: of each paper's pages (its documents
    in order) the first ``pages`` that have any text are read, and the first identifier found counts."""
    docs = table(spark, d, "documents").where("paper_id is not null").select(c("paper_id").alias("id"), "doc_id", R.clean(c("text")).alias("page")).where("page != ''")
    # the first pages by an aggregate of few rows each, so a paper of very many pages is no burden
    first = docs.groupBy("id", F.pmod(F.xxhash64("doc_id"), F.lit(32)).alias("part")).agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, pages).alias("l"))
    first = first.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, pages).alias("l")).select(F.explode("l").alias("doc_id"))
    read = docs.join(first, "doc_id").select("id", "doc_id", "page", R.found_dois(c("page")).alias("dois"), R.found_arxiv(c("page")).alias("ids"))
    earliest = lambda x: F.min_by(c(x)[0], F.when(F.size(x) > 0, c("doc_id")))
    found = read.groupBy("id").agg(earliest("dois").alias("page_doi"), earliest("ids").alias("page_arxiv"), F.min_by("page", "doc_id").alias("page"), F.count(F.lit(1)).alias("n_pages"))
    fill = lambda own, x: F.when(own != "", own).otherwise(R.text(c(x)))
    p = candidates(spark, d).join(found, "id")
    return p.select("id", fill(R.bare_doi(c("doi")), "page_doi").alias("doi"), fill(R.bare_arxiv(c("arxiv_id")), "page_arxiv").alias("arxiv_id"), F.md5(R.shorten(c("page"), chars, "...")).alias("excerpt_md5"), "n_pages")


def adapter_choice(spark, d):
    """Sources asked for each template: the best one or two, none for identifiers."""
    ranks = {"openindex": 1, "scholargraph": 2, "preprints": 3, "xref": 4}
    literal = spark.createDataFrame([(t, 0 if t == "identifier_targeted" else 1 if t in ("conference_program_first", "bibliography_index") else 2) for t in PLANS], "template string, most int")
    s = candidates(spark, d).select("source").distinct()
    rank = F.coalesce(*[F.when(c("source") == k, v) for k, v in ranks.items()], F.lit(10))
    s = s.withColumn("place", F.row_number().over(W.orderBy(rank, "source")))
    return s.join(F.broadcast(literal), c("place") <= c("most")).select("template", "source")


def extraction(spark, d):
    """The first three sections of each document, a value and its evidence for each field, and what the check says."""
    docs = table(spark, d, "documents").where("text is not null")
    sections = F.slice(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""), 1, 3)
    fields = F.array(F.lit("method"), F.lit("result"))
    x = docs.select("doc_id", sections.alias("s")).where(F.size("s") > 0)
    return x.select("doc_id", F.explode(fields).alias("field"), "s").select(
        "doc_id", "field", F.concat(F.lit("stub_"), c("field")).alias("value"), F.lit("s1").alias("section_id"), F.md5(F.substring(c("s")[0], 1, 120)).alias("quote_md5"), F.size("s").cast("long").alias("n_sections"), F.lit("unverified").alias("status"))


def report_lines(spark, d):
    """One line a source with its documents, in order."""
    g = table(spark, d, "documents").groupBy(R.text(c("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))
    return g.select("source", F.concat(F.lit("- "), c("source"), F.lit(": "), c("n"), F.lit(" documents, "), c("chars"), F.lit(" characters")).alias("line"))


def sessions(spark, d):
    """Search sessions over all prompts at once, to their end: one row a cycle."""
    p = prompts(spark, d).select(c("qid").alias("session"), "prompt")
    rows = candidates(spark, d).where("title != ''").groupBy(R.title_words(c("title")).alias("t")).agg(F.min_by(F.struct(c("id").alias("key"), "title", "score"), "ord").alias("r")).select("r.*")
    return run_sessions(p, rows).select("session", "cycle", "move", "reason", F.size("keys").alias("n_keys"))


QUERIES = {
    "q_sessions": sessions, "q_plan_items": plan_items, "q_template_plans": template_plans, "q_deterministic_queries": deterministic_queries, "q_seed_queries": seed_queries, "q_seed_budget": seed_budget, "q_fit_scores": fit_scores,
    "q_next_searches": next_searches, "q_cycle_decisions": cycle_decisions, "q_router_labels": router_labels, "q_resolve_consensus": resolve_consensus, "q_resolve_fast": resolve_fast, "q_resolve_titles": resolve_titles,
    "q_open_handoff": open_handoff, "q_index_compact": index_compact, "q_greedy_compaction": greedy_compaction, "q_preferred_paper": preferred_paper, "q_page_hints": page_hints, "q_cycle_plans": cycle_plans, "q_deterministic_rows": deterministic_rows, "q_router_fallbacks": router_fallbacks, "q_session_status": session_status, "q_adapter_choice": adapter_choice,
    "q_extraction": extraction, "q_report_lines": report_lines,
}

_PLAN_ROWS = ", ".join(f"('{t}', {i}, '{a}', '{b}', '{s}', '{n}')" for t, xs in PLANS.items() for i, (a, b, s, n) in enumerate(xs, 1))
_TEMPLATES = rf"SELECT s.qid, {_TEMPLATE} AS template, trim(regexp_replace(q.seed, '\s+', ' ', 'g'), ' ') AS seed FROM ({_SIGNALS}) s JOIN ({SCALAR_SQL['q_query_seed']}) q USING (qid)"
_LATER = rf"""SELECT t.qid, CASE WHEN template = 'identifier_targeted' AND r.title <> '' THEN 'scholar_graph' ELSE template END AS template,
  trim(regexp_replace(concat_ws(' ', seed, array_to_string(list_slice(string_split(trim(regexp_replace(r.title, '\s+', ' ', 'g'), ' '), ' '), 1, 6), ' ')), '\s+', ' ', 'g'), ' ') AS seed FROM ({_TEMPLATES}) t JOIN ({REQUESTS}) r USING (qid)"""
_PLAN_SQL = f"SELECT qid, t.template, step, concat(pre, seed, post) AS query, scope, intent FROM ({_TEMPLATES}) t JOIN (VALUES {_PLAN_ROWS}) v(template, step, pre, post, scope, intent) ON t.template = v.template WHERE seed <> ''"
_ORDER = "score DESC, (doi <> '')::INT DESC, (arxiv_id <> '')::INT DESC, length(title) DESC, first_ord"
_RANKED = f"SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM (SELECT *, min(ord) OVER (PARTITION BY key) AS first_ord, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS rn FROM (SELECT *, {s_dedup()} AS key FROM ({CANDIDATES}))) WHERE rn = 1"
_STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) >= 3))"


_ASKED = f"""SELECT qid, mode, CASE mode WHEN 'doi' THEN d WHEN 'arxiv' THEN a END AS value FROM (SELECT qid, d, a, CASE WHEN d <> '' THEN 'doi' WHEN a <> '' THEN 'arxiv' WHEN title <> '' THEN 'title' ELSE 'none' END AS mode
FROM (SELECT qid, title, CASE WHEN {s_alias('doi')} <> '' THEN '' ELSE {s_doi('doi')} END AS d, CASE WHEN g <> '' THEN g ELSE {s_alias('doi')} END AS a FROM (SELECT *, CASE WHEN arxiv_id <> '' THEN {s_arxiv('arxiv_id')} ELSE {s_arxiv('arxiv_url')} END AS g FROM ({REQUESTS})))) WHERE mode IN ('doi', 'arxiv')"""
_IDENT = f"""SELECT *, 'doi' AS mode, {s_doi('doi')} AS value FROM ({CANDIDATES}) WHERE {s_doi('doi')} <> '' UNION ALL SELECT *, 'arxiv', {s_arxiv('arxiv_id')} FROM ({CANDIDATES}) WHERE {s_arxiv('arxiv_id')} <> ''
UNION ALL SELECT *, 'arxiv', {s_alias('doi')} FROM ({CANDIDATES}) WHERE {s_alias('doi')} <> '' AND {s_alias('doi')} <> {s_arxiv('arxiv_id')}"""


def _resolve_sql(fast: bool) -> str:
    place = "coalesce(nullif(list_position([" + ", ".join(f"'{s}'" for s in SOURCES) + f"], source), 0), {len(SOURCES) + 1})"
    rows = f"SELECT * FROM (SELECT *, {place} AS place, min({place}) OVER (PARTITION BY mode, value) AS least FROM ({_IDENT})) WHERE place = least" if fast else _IDENT
    return f"""WITH k AS ({rows}), g AS (SELECT mode, value, count(*) AS n_rows, count(DISTINCT source) AS n_sources, coalesce(min(nullif({s_doi('doi')}, '')), '') AS doi, coalesce(min(nullif({s_arxiv('arxiv_id')}, '')), '') AS arxiv_id, coalesce(min(nullif(trim(year, ' '), '')), '') AS year FROM k GROUP BY 1, 2),
b AS (SELECT mode, value, title FROM (SELECT *, row_number() OVER (PARTITION BY mode, value ORDER BY (doi <> '')::INT DESC, (arxiv_id <> '')::INT DESC, score DESC, length(title) DESC, ord) AS rn FROM k) WHERE rn = 1)
SELECT q.qid, q.mode, CASE WHEN g.mode IS NULL THEN 'not_found' ELSE 'resolved' END AS status, CASE WHEN g.mode IS NULL THEN '' ELSE {s_paper_id('g.doi', 'g.arxiv_id', 'b.title', 'g.year')} END AS paper_id,
  coalesce(g.n_rows, 0) AS n_rows, coalesce(g.n_sources, 0) AS n_sources, coalesce(b.title, '') AS title, coalesce(g.year, '') AS year FROM ({_ASKED}) q LEFT JOIN g ON q.mode = g.mode AND q.value = g.value LEFT JOIN b ON q.mode = b.mode AND q.value = b.value"""


SQL = {
    "q_plan_items": f"SELECT qid, pos - 1 AS pos, trim(l[pos], ' ') AS query FROM (SELECT qid, CASE WHEN trim(prompt, ' ') = '' THEN ['research paper', 'arxiv'] ELSE [trim(prompt, ' '), concat(trim(prompt, ' '), ' research paper'), concat(trim(prompt, ' '), ' arxiv')] END AS l FROM ({PROMPTS})), (SELECT unnest([1, 2, 3]) AS pos) WHERE pos <= len(l)",
    "q_template_plans": _PLAN_SQL,
    "q_cycle_plans": _PLAN_SQL.replace(_TEMPLATES, _LATER),
    "q_router_fallbacks": f"""WITH t AS (SELECT qid, template, max((scope = 'web')::INT) AS w, max((scope = 'scholarly')::INT) AS s FROM ({_PLAN_SQL}) GROUP BY 1, 2),
l AS (SELECT qid, CASE WHEN template IN ('conference_program_first', 'bibliography_index') AND w = 1 AND s = 1 THEN 'web_then_scholarly' WHEN s = 1 AND w = 0 THEN 'scholarly_only' WHEN w = 1 AND s = 0 THEN 'web_only' ELSE 'mixed' END AS l FROM t)
SELECT qid, CASE WHEN qid % 2 <> 0 THEN l WHEN qid % 3 = 0 THEN concat(l, '_web_disabled') WHEN qid % 5 = 0 THEN concat(l, '_provider_unsupported') WHEN qid % 4 > 0 THEN 'scholarly_plus_web' ELSE 'scholarly_only_web_unavailable' END AS router FROM l""",
    "q_seed_queries": f"""WITH b AS (SELECT id, {s_doi('doi')} AS d, {s_arxiv('arxiv_id')} AS a, trim(title, ' ') AS t, concat_ws(' ', title, url, abstract) AS body FROM ({CANDIDATES})),
f AS (SELECT *, {_DOIS_IN.format(c='body')} AS dois, {_ARXIV_IN.format(c='body')} AS ids FROM b),
s AS (SELECT id, list_concat(list_filter([CASE WHEN d <> '' THEN concat('doi:', d) END, CASE WHEN a <> '' THEN concat('arxiv:', a) END, CASE WHEN t <> '' THEN concat('title:', t) END], lambda x: x IS NOT NULL), list_transform(dois, lambda x: concat('doi:', x)), list_transform(ids, lambda x: concat('arxiv:', x))) AS l FROM f),
u AS (SELECT id, {_first_seen('l')} AS l FROM s) SELECT id, pos - 1 AS pos, md5(l[pos]) AS seed_md5 FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS pos FROM u)""",
    "q_page_hints": f"""WITH p AS (SELECT paper_id AS id, doc_id, {s_clean('text')} AS page FROM documents WHERE paper_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS n FROM p WHERE page <> ''),
f AS (SELECT *, {_DOIS_IN.format(c='page')} AS dois, {_ARXIV_IN.format(c='page')} AS ids FROM n WHERE n <= 3),
g AS (SELECT id, arg_min(dois[1], doc_id) FILTER (len(dois) > 0) AS d, arg_min(ids[1], doc_id) FILTER (len(ids) > 0) AS a, arg_min(page, doc_id) AS page, count(*) AS n FROM f GROUP BY 1)
SELECT c.id, CASE WHEN {s_doi('doi')} <> '' THEN {s_doi('doi')} ELSE coalesce(g.d, '') END AS doi, CASE WHEN {s_arxiv('arxiv_id')} <> '' THEN {s_arxiv('arxiv_id')} ELSE coalesce(g.a, '') END AS arxiv_id, md5({s_shorten('g.page', 600, '...')}) AS excerpt_md5, g.n AS n_pages
FROM ({CANDIDATES}) c JOIN g ON c.id = g.id""",
    "q_deterministic_queries": f"""WITH s AS ({_SIGNALS}), x AS (SELECT qid, 'doi' AS kind, unnest(dois) AS value, 'fast' AS policy FROM s UNION ALL SELECT qid, 'arxiv_id', unnest(arxiv_ids), 'fast' FROM s)
SELECT * FROM x UNION ALL SELECT qid, 'title', hint, 'consensus' FROM s WHERE hint <> '' AND len(dois) = 0 AND len(arxiv_ids) = 0""",
    "q_seed_budget": f"""WITH r AS ({_RANKED}), s AS (SELECT rank, 0 AS pos, concat('doi:', {s_doi('doi')}) AS seed FROM r WHERE rank <= 240 AND {s_doi('doi')} <> '' UNION ALL SELECT rank, 1, concat('arxiv:', {s_arxiv('arxiv_id')}) FROM r WHERE rank <= 240 AND {s_arxiv('arxiv_id')} <> ''
  UNION ALL SELECT rank, 2, concat('title:', trim(title, ' ')) FROM r WHERE rank <= 240 AND trim(title, ' ') <> ''),
f AS (SELECT seed, min(rank * 10 + pos) AS first_at FROM s GROUP BY 1) SELECT row_number() OVER (ORDER BY first_at) AS place, md5(seed) AS seed_md5 FROM f QUALIFY place <= 240""",
    "q_fit_scores": f"""WITH q AS (SELECT qid, {s_title('title')} AS t, title AS asked FROM ({REQUESTS}) WHERE {s_title('title')} <> ''),
p AS (SELECT * FROM (SELECT *, {s_title('title')} AS t, row_number() OVER (PARTITION BY {s_title('title')} ORDER BY ord) AS n FROM ({CANDIDATES})) WHERE n = 1),
x AS (SELECT q.qid, p.id, p.doi, p.arxiv_id, list_filter({_tok('q.asked')}, lambda w: NOT list_contains({_STOP}, w)) AS pt, {_tok("concat_ws(' ', p.title, p.abstract, p.venue, array_to_string(p.keywords, ' '), array_to_string(p.categories, ' '))")} AS tt FROM q JOIN p ON q.t = p.t),
o AS (SELECT *, list_sort(list_filter(pt, lambda w: list_contains(tt, w))) AS ov FROM x),
f AS (SELECT *, least(1.0, CASE WHEN len(pt) > 0 THEN len(ov) / len(pt)::DOUBLE ELSE 0.0 END + CASE WHEN doi <> '' OR arxiv_id <> '' THEN 0.15 ELSE 0 END) AS s FROM o)
SELECT qid, id, round(s, 6) AS fit, CASE WHEN len(ov) > 0 THEN concat('overlap=', array_to_string(list_slice(ov, 1, 6), ',')) ELSE 'no_token_overlap' END AS reason, CASE WHEN s >= 0.12 THEN 'keep' WHEN s >= 0.09 THEN 'keep_raw_fit' ELSE 'ignore' END AS verdict FROM f""",
    "q_next_searches": f"""WITH s AS (SELECT {s_title('venue')} AS query, count(*) AS n_rows, CAST(sum(({s_doi('doi')} <> '')::INT + ({s_arxiv('arxiv_id')} <> '')::INT) AS BIGINT) AS n_ids, max((trim(title, ' ') <> '')::INT) AS titled FROM ({CANDIDATES}) GROUP BY 1)
SELECT query, n_rows, n_ids, CASE WHEN NOT (n_ids > 0 OR titled > 0) THEN 'tune' WHEN n_ids >= 3 THEN 'deepen' WHEN n_rows >= 5 THEN 'expand' ELSE 'stop' END AS move,
  trim(CASE WHEN NOT (n_ids > 0 OR titled > 0) THEN concat(query, ' paper DOI arXiv') WHEN n_ids >= 3 THEN concat(query, ' related work') WHEN n_rows >= 5 THEN concat(query, ' recent') ELSE '' END, ' ') AS next_query FROM s""",
    "q_cycle_decisions": """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(DISTINCT event_type)) AS keys, count(*) FILTER (value < 5) AS ignored FROM events GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER w AS cycle, lag(keys) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day)),
y AS (SELECT *, len(list_filter(keys, lambda k: k <> 'error')) AS listed, len(list_filter(keys, lambda k: NOT list_contains(coalesce(before, []), k))) AS delta FROM x)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, cycle, CAST(delta AS BIGINT) AS candidate_delta,
  CASE WHEN listed = 0 OR cycle >= 6 THEN 'stop' WHEN cycle < 2 THEN 'continue' WHEN keys = before THEN 'stop' ELSE 'continue' END AS move,
  CASE WHEN listed = 0 AND ignored > 0 THEN 'needs_user_feedback' WHEN listed = 0 THEN 'no_candidates' WHEN cycle >= 6 THEN 'cycle_budget_reached' WHEN cycle < 2 THEN 'minimum_refinement_cycles_not_met' WHEN keys = before THEN 'converged_candidate_set' ELSE 'refinement_budget_available' END AS reason FROM y""",
    "q_router_labels": f"SELECT qid, CASE WHEN w = 1 AND s = 1 THEN 'web_then_scholarly' WHEN s = 1 THEN 'scholarly_only' WHEN w = 1 THEN 'web_only' ELSE 'mixed' END AS router FROM (SELECT qid, max((scope = 'web')::INT) AS w, max((scope = 'scholarly')::INT) AS s FROM ({_PLAN_SQL}) GROUP BY 1)",
    "q_resolve_consensus": _resolve_sql(False),
    "q_resolve_fast": _resolve_sql(True),
    "q_open_handoff": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS rank FROM (SELECT *, min(ord) OVER (PARTITION BY source, key) AS first_ord, row_number() OVER (PARTITION BY source, key ORDER BY score DESC, ord) AS rn FROM (SELECT *, {s_dedup()} AS key FROM ({CANDIDATES}))) WHERE rn = 1)
SELECT source, rank, CASE WHEN lower(trim(doi, ' ')) <> '' THEN concat('doi:', lower(trim(doi, ' '))) WHEN lower(trim(arxiv_id, ' ')) <> '' THEN concat('arxiv:', lower(trim(arxiv_id, ' '))) ELSE concat('title:', lower(trim(title, ' ')), ':', trim(year, ' ')) END AS candidate_key,
  CASE WHEN {s_doi('doi')} <> '' OR {s_arxiv('arxiv_id')} <> '' THEN 'resolved' ELSE 'skipped' END AS status, CASE WHEN rank <= 5 THEN '1' ELSE '' END AS selected FROM r WHERE rank <= 20""",
    "q_index_compact": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY position, author_id) AS n FROM (SELECT paper_id, author_id, min(coalesce(position, 1000000000)) AS position FROM paper_authors GROUP BY 1, 2)),
s AS (SELECT paper_id, count(*) AS k, string_agg(author_id, ',' ORDER BY n) FILTER (n <= 12) AS authors FROM a GROUP BY 1)
SELECT c.id, md5({s_shorten("trim(abstract, ' ')", 1200, '…')}) AS abstract_md5, coalesce(s.k, 0) AS author_count, coalesce(s.authors, '') AS authors, greatest(0, coalesce(s.k, 0) - 12) AS truncated FROM ({CANDIDATES}) c LEFT JOIN s ON c.id = s.paper_id""",
    "q_preferred_paper": f"""WITH q AS (SELECT DISTINCT {s_title('title')} AS t, {s_arxiv('arxiv_id')} AS a FROM ({REQUESTS}) WHERE {s_arxiv('arxiv_id')} <> ''), n AS (SELECT paper_id, count(DISTINCT author_id) AS k FROM paper_authors GROUP BY 1),
p AS (SELECT c.*, {s_title('title')} AS t, {s_arxiv('arxiv_id')} AS a, coalesce(n.k, 0) AS k FROM ({CANDIDATES}) c LEFT JOIN n ON c.id = n.paper_id WHERE title <> '')
SELECT t, id AS preferred, n FROM (SELECT p.*, count(*) OVER (PARTITION BY p.t) AS n, row_number() OVER (PARTITION BY p.t ORDER BY (q.a IS NOT NULL)::INT DESC, (p.a <> '')::INT DESC, ({s_doi('doi')} <> '')::INT DESC, length(abstract) DESC, k DESC, ord) AS rn
FROM p LEFT JOIN q ON p.t = q.t AND p.a = q.a) WHERE rn = 1""",
    "q_adapter_choice": "WITH s AS (SELECT source, row_number() OVER (ORDER BY CASE source WHEN 'openindex' THEN 1 WHEN 'scholargraph' THEN 2 WHEN 'preprints' THEN 3 WHEN 'xref' THEN 4 ELSE 10 END, source) AS place FROM (SELECT DISTINCT source FROM papers)) SELECT template, source FROM s JOIN (VALUES ('conference_program_first', 1), ('bibliography_index', 1), ('scholar_graph', 2), ('mixed_theme', 2)) v(template, most) ON place <= most",
    "q_extraction": """WITH x AS (SELECT doc_id, list_slice(list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> ''), 1, 3) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, field, concat('stub_', field) AS value, 's1' AS section_id, md5(substr(s[1], 1, 120)) AS quote_md5, CAST(len(s) AS BIGINT) AS n_sections, 'unverified' AS status FROM x, (VALUES ('method'), ('result')) f(field) WHERE len(s) > 0""",
    "q_report_lines": "SELECT coalesce(source, '') AS source, concat('- ', coalesce(source, ''), ': ', count(*), ' documents, ', CAST(sum(coalesce(n_chars, 0)) AS BIGINT), ' characters') AS line FROM documents GROUP BY 1",
    "q_deterministic_rows": f"""SELECT qid, 'deterministic' AS source, paper_id AS source_id, title, CASE WHEN starts_with(paper_id, 'doi:') THEN substr(paper_id, 5) ELSE '' END AS doi, arxiv_id, 1.2::DOUBLE AS score, 'deterministic_resolved' AS reason FROM ({_resolve_sql(False).replace("coalesce(g.year, '') AS year", "coalesce(g.arxiv_id, '') AS arxiv_id")}) WHERE status = 'resolved'""",
}
SQL["q_session_status"] = f"""WITH l AS ({SQL["q_cycle_decisions"]}), e AS (SELECT user_id AS session, max(cycle) AS cycle, arg_max(move, cycle) AS move, arg_max(reason, cycle) AS reason FROM l GROUP BY 1)
SELECT session, cycle, CASE WHEN move = 'stop' AND reason <> 'needs_user_feedback' OR session % 2 = 0 THEN 'completed' WHEN move = 'stop' THEN 'needs_input' ELSE 'running' END AS status,
  CASE WHEN move = 'stop' AND reason <> 'needs_user_feedback' THEN reason WHEN session % 2 = 0 THEN 'user_finalized' WHEN move = 'stop' THEN reason ELSE '' END AS stop_reason FROM e"""
