"""Column builders for bibliographic records: identifiers, keys, text, scores and plans.

Rows mark a missing value by an empty string; builders take null as empty and
never return null unless they say so.  All are built-in expressions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIAS_PREFIX = "10.48550/arxiv."
#: Prefixes of which a DOI loses the first that fits.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:")
_ONE_PREFIX = "^(?:" + "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES) + ")"
DOI_IN_TEXT = r"(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)"
ARXIV_IN_TEXT = r"\b([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)\b"
ARXIV_URL_IN_TEXT = r"(?i)(https?://arxiv\.org/(?:abs|pdf)/[^\s]+)"
MAX_TERMS = 12
# Words that don't count in a prompt.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "into", "about", "latest", "paper", "papers", "research", "top", "conference", "conferences", "find", "details", "related", "work", "on")
# Pages worth fetching.
TARGET_DOMAINS = ("dblp.org", "openreview.net", "acm.org", "ieeexplore.ieee.org", "neurips.cc", "iclr.cc", "proceedings.mlr.press")
SCHOLAR_DOMAIN = "scholar.google.com"
# The five entities decoded without a full table.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def text(c: Column) -> Column:
    """The value, empty for null."""
    return F.coalesce(c, F.lit(""))


def has(c: Column) -> Column:
    return text(c) != ""


def bare_doi(c: Column) -> Column:
    """Trimmed and lower-cased, without one prefix."""
    return F.regexp_replace(F.lower(F.trim(text(c))), _ONE_PREFIX, "")


def bare_arxiv(c: Column) -> Column:
    """The arXiv id out of an id or address; what is neither stays as it is.

    One chain of steps, so that none is worked out twice.
    """
    v = F.regexp_replace(F.lower(F.regexp_replace(text(c), r"^\s+|\s+$", "")), r"^arxiv:", "")
    # of an address that names the site, what stands before the path and the path's first part
    v = F.regexp_replace(v, r"^(?=.*arxiv\.org/)(?:[a-z][a-z0-9+.-]*://)?[^/?#]*(?:/(?:abs|pdf)/|/+)?", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"[?#].*$", ""), r"\.pdf$", ""), r"v[0-9]+$", "")


def title_words(c: Column) -> Column:
    """Lower-cased letters and digits, words parted by one blank."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]+", " "))


def alias_arxiv(doi: Column) -> Column:
    """The arXiv id behind an alias DOI, else empty."""
    return bare_arxiv(F.regexp_extract(bare_doi(doi), r"(?s)^10\.48550/arxiv\.(.*)$", 1))


def lookup_ids(doi: Column, arxiv_url: Column, arxiv_id: Column) -> tuple[Column, Column]:
    """(doi, arxiv id) to look a request up by: an alias DOI becomes its arXiv id, unless one is given."""
    alias = alias_arxiv(doi)
    given = F.when(has(arxiv_id), bare_arxiv(arxiv_id)).otherwise(bare_arxiv(arxiv_url))
    return F.when(alias != "", "").otherwise(bare_doi(doi)), F.when(given != "", given).otherwise(alias)


def query_key(doi: Column, arxiv_url: Column, arxiv_id: Column, title: Column) -> Column:
    d, a = lookup_ids(doi, arxiv_url, arxiv_id)
    t = title_words(title)
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(a != "", F.concat(F.lit("arxiv:"), a)).when(t != "", F.concat(F.lit("title:"), t)).otherwise("empty")


def lookup_mode(doi: Column, arxiv_url: Column, arxiv_id: Column, title: Column) -> Column:
    d, a = lookup_ids(doi, arxiv_url, arxiv_id)
    return F.when(d != "", "doi").when(a != "", "arxiv").when(has(title), "title").otherwise("none")


def input_warnings(doi: Column, arxiv_url: Column) -> Column:
    d, u = F.lower(bare_doi(doi)), F.lower(text(arxiv_url))
    return F.array_compact(F.array(
        F.when(d.contains("arxiv.org/"), "doi_argument_looks_like_arxiv_url"),
        F.when(u.contains("doi.org/"), "arxiv_url_argument_looks_like_doi_url"),
        F.when((d != "") & ~d.startswith("10."), "doi_argument_not_normalized"),
        F.when(alias_arxiv(d) != "", "doi_argument_is_arxiv_doi_alias"),
    ))


def paper_id(doi: Column, arxiv_id: Column, title: Column, year: Column) -> Column:
    """The stable id of a record whose identifiers are bare."""
    return F.when(has(doi), F.concat(F.lit("doi:"), doi)).when(has(arxiv_id), F.concat(F.lit("arxiv:"), arxiv_id)).otherwise(F.concat(F.lit("title:"), title_words(title), F.lit(":"), text(year)))


def digest(payload: Column) -> Column:
    return F.substring(F.sha1(payload), 1, 16)


def org_id(name: Column, ror: Column, source: Column) -> Column:
    payload = F.concat(text(source), F.lit("|"), F.lower(F.trim(text(name))))
    return F.when(has(ror), F.concat(F.lit("ror:"), F.lower(ror))).otherwise(F.concat(F.lit("org:"), text(source), F.lit(":"), digest(payload)))


def author_id(name: Column, orcid: Column, source_id: Column, source: Column, affiliations: Column) -> Column:
    """``affiliations`` is an array of names; their order and repeats don't matter."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(affiliations, lambda a: has(a)), lambda a: F.lower(F.trim(a))))), "|")
    payload = F.concat_ws("|", text(source), F.lower(F.trim(text(name))), names)
    return (
        F.when(has(orcid), F.concat(F.lit("orcid:"), F.lower(orcid))).when(has(source_id), F.concat(text(source), F.lit(":"), source_id))
        .otherwise(F.concat(F.lit("author:"), text(source), F.lit(":"), digest(payload)))
    )


def source_label(source: Column) -> Column:
    return F.lower(F.trim(F.when(has(source), source).otherwise("unknown")))


def fallback_key(source: Column, source_id: Column, title: Column, year: Column, doi: Column, arxiv_id: Column, url: Column) -> Column:
    s, i = source_label(source), F.trim(text(source_id))
    payload = F.concat_ws("|", s, *[text(x) for x in (title, year, doi, arxiv_id, url)])
    return F.when(i != "", F.concat(s, F.lit(":"), i)).otherwise(F.concat(s, F.lit(":fallback:"), digest(payload)))


def cache_key(source: Column, source_id: Column, doi: Column, arxiv_id: Column, title: Column, year: Column) -> Column:
    s, i, d, a = source_label(source), F.trim(text(source_id)), F.lower(F.trim(text(doi))), F.lower(F.trim(text(arxiv_id)))
    join = lambda *p: F.concat(*p)
    return (
        F.when(i != "", join(s, F.lit(":"), i)).when(d != "", join(s, F.lit(":doi:"), d)).when(a != "", join(s, F.lit(":arxiv:"), a))
        .otherwise(join(s, F.lit(":title:"), title_words(title), F.lit(":"), text(year)))
    )


def dedup_key(doi: Column, arxiv_id: Column, title: Column, year: Column) -> Column:
    """One key a record: DOI before arXiv id before title and year."""
    return paper_id(bare_doi(doi), bare_arxiv(arxiv_id), title, year)


def loose_key(doi: Column, arxiv_id: Column, title: Column, year: Column) -> Column:
    """The same order with values only trimmed and lower-cased."""
    d, a = F.lower(F.trim(text(doi))), F.lower(F.trim(text(arxiv_id)))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(a != "", F.concat(F.lit("arxiv:"), a)).otherwise(
        F.concat(F.lit("title:"), F.lower(F.trim(text(title))), F.lit(":"), F.trim(text(year)))
    )


def paper_keys(pid: Column, doi: Column, arxiv_id: Column, title: Column) -> Column:
    """All keys a record can be found by, sorted."""
    return key_set(pid, bare_doi(doi), bare_arxiv(arxiv_id), alias_arxiv(doi), title_words(title))


def key_set(pid: Column, doi: Column, arxiv_id: Column, alias: Column, title: Column) -> Column:
    """The same of values in their bare forms."""
    tag = lambda p, v: F.when(v != "", F.concat(F.lit(p), v))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.when(has(pid), pid), tag("doi:", doi), tag("arxiv:", arxiv_id), tag(f"doi:{ALIAS_PREFIX}", arxiv_id), tag("arxiv:", alias), tag(f"doi:{ALIAS_PREFIX}", alias), tag("title:", title),
    ))))


def alias_keys(keys: Column) -> Column:
    """Query keys in lower case, sorted, with the arXiv key of every alias DOI."""
    low = F.filter(F.transform(keys, lambda k: F.lower(F.trim(text(k)))), lambda k: k != "")
    more = F.transform(F.filter(low, lambda k: k.startswith("doi:")), lambda k: alias_arxiv(F.substring(k, 5, 2_000_000)))
    return F.array_sort(F.array_distinct(F.concat(low, F.transform(F.filter(more, lambda a: a != ""), lambda a: F.concat(F.lit("arxiv:"), a)))))


def arxiv_of_keys(keys: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(keys, lambda k: F.lower(k).startswith("arxiv:")), lambda k: F.substring(F.lower(k), 7, 2_000_000)), lambda k: k != "")))


def digits_or_empty(year: Column) -> Column:
    y = F.trim(text(year))
    return F.when(y.rlike(r"^[0-9]+$"), y).otherwise("")


def clean(c: Column) -> Column:
    """Entities decoded, tags out, white space single."""
    return F.trim(F.regexp_replace(_untagged(c), r"\s+", " "))


def clean_words(c: Column) -> Column:
    """The same, split at its blanks, in one pass."""
    return F.split(F.btrim(_untagged(c), F.lit(" \t\n\x0b\f\r")), r"\s+")


def _untagged(c: Column) -> Column:
    v = text(c)
    for name, char in ENTITIES:
        v = F.replace(v, F.lit(name), F.lit(char))
    return F.regexp_replace(v, r"<[^>]+>", " ")


def shorten(c: Column, n: int, mark: str = "…") -> Column:
    """At most n characters; what is cut ends in the mark."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n - len(mark)), r"\s+$", ""), F.lit(mark)))


def distinct_terms(terms: Column, most: int = MAX_TERMS) -> Column:
    """Terms in order, first spelling of each, case aside."""
    cleaned = F.filter(F.transform(terms, clean), lambda t: t != "")
    kept = F.aggregate(
        cleaned, F.array().cast("array<string>"),
        lambda acc, t: F.when(F.exists(acc, lambda o: F.lower(o) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t))),
    )
    return F.slice(kept, 1, most)


def found_dois(c: Column) -> Column:
    raw = F.regexp_extract_all(text(c), F.lit(DOI_IN_TEXT), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda d: bare_doi(F.regexp_replace(d, r"[.,);\]]+$", ""))), lambda d: d != ""))


def found_arxiv(c: Column) -> Column:
    raw = F.regexp_extract_all(text(c), F.lit(ARXIV_IN_TEXT), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, bare_arxiv), lambda a: a != ""))


def prompt_arxiv(c: Column) -> Column:
    urls = F.transform(F.regexp_extract_all(text(c), F.lit(ARXIV_URL_IN_TEXT), F.lit(1)), bare_arxiv)
    return F.array_distinct(F.filter(F.concat(urls, found_arxiv(c)), lambda a: a != ""))


def title_hint(c: Column) -> Column:
    return F.trim(F.regexp_extract(text(c), r'"([^"]{8,220})"', 1))


# Words of a prompt that choose its plan, in the order in which they are looked for.
PLAN_WORDS = (
    (("dblp", "bibliography", "proceedings", "acm dl"), "bibliography_index"),
    (("google scholar", "cited by", "citation", "related work"), "scholar_graph"),
    (("conference", "program", "accepted papers", "track"), "conference_program_first"),
    (("latest", "recent", "top", "papers on", "paper on", "theme", "survey", "state of the art"), "conference_program_first"),
)
# Phrases that a search leaves out of a prompt, and what stands for them, in order.
SEED_PHRASES = (
    (r"(?i)https?://arxiv\.org/(?:abs|pdf)/\S+", " "), (r"(?i)https?://doi\.org/\S+", " "), (r"(?i)\bdoi\b", " "), (r"(?i)\barxiv\b", " "),
    (r"(?i)^(?:find details for |details for |find |show me |give me )\s*", ""), (r"(?i)^(?:latest papers? on |papers? on |find papers on |search papers on )\s*", ""),
    (r"(?i)from top ai conferences|top ai conferences", " "), (r"(?i)latest ", " "), (r"(?i)recent ", " "), (r"(?i)\bfor and\b", " "), (r"(?i)\band related work\b", " related work"),
)


def plan_template(prompt: Column, identified: Column) -> Column:
    p = F.lower(text(prompt))
    out = F.when(identified, "identifier_targeted")
    for words, template in PLAN_WORDS:
        out = out.when(F.exists(F.array(*[F.lit(t) for t in words]), lambda t: p.contains(t)), template)
    return out.otherwise("mixed_theme")


def bare_seed(prompt: Column, known: Column) -> Column:
    """The prompt without the identifiers in the array ``known``, addresses and set phrases."""
    low_replace = lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"(?i)\Q"), x, F.lit(r"\E")), F.lit(" "))
    s = F.aggregate(known, F.trim(text(prompt)), low_replace)
    for phrase, by in SEED_PHRASES:
        s = F.regexp_replace(s, phrase, by)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def seed_or_hint(seed: Column, hint: Column, prompt: Column) -> Column:
    """The seed; the quoted title if nothing much is left of it; the prompt if there is neither."""
    few = F.size(F.regexp_extract_all(F.lower(seed), F.lit("([a-z0-9]{3,})"), F.lit(1))) <= 1
    return F.coalesce(F.nullif(F.when(few & (hint != ""), hint).otherwise(seed), F.lit("")), F.trim(text(prompt)))


def cycle_seed(seed: Column, cycle: Column, best_title: Column) -> Column:
    """What a cycle searches for: the seed, from the second cycle on with the first six words of the best candidate so far."""
    anchor = F.substring_index(F.trim(F.regexp_replace(text(best_title), r"\s+", " ")), " ", 6)
    return F.when((cycle > 1) & (anchor != ""), F.trim(F.concat_ws(" ", seed, anchor))).otherwise(seed)


def cycle_template(template: Column, cycle: Column, best_title: Column) -> Column:
    """The template of a cycle: identifiers are looked up in the first one, later ones go on from what was found."""
    return F.when((template == "identifier_targeted") & (cycle > 1) & has(best_title), "scholar_graph").otherwise(template)


def router_label(template: Column, web: Column, scholarly: Column, short: Column, fallback: Column, provider: Column, fallback_rows: Column) -> Column:
    """Which ways a cycle took; ``short`` says that it ranked too few rows, so that the web was asked again (or why not)."""
    label = (
        F.when(template.isin("conference_program_first", "bibliography_index") & web & scholarly, "web_then_scholarly")
        .when(scholarly & ~web, "scholarly_only").when(web & ~scholarly, "web_only").otherwise("mixed")
    )
    again = (
        F.when(~fallback, F.concat(label, F.lit("_web_disabled"))).when(provider != "searxng", F.concat(label, F.lit("_provider_unsupported")))
        .when(fallback_rows > 0, "scholarly_plus_web").otherwise("scholarly_only_web_unavailable")
    )
    return F.when(short, again).otherwise(label)


def tokens(c: Column) -> Column:
    """Distinct lower-case words of three letters or digits at least."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 3))


def fit_overlap(prompt: Column, target: Column) -> Column:
    """Sorted words that the prompt shares with the target."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_sort(F.array_intersect(F.array_except(tokens(prompt), stop), tokens(target)))


def fit_score(prompt: Column, overlap: Column, identified: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    n = F.size(F.array_except(tokens(prompt), stop))
    base = F.when(n > 0, F.size(overlap) / n).otherwise(0.0)
    return F.least(F.lit(1.0), base + F.when(identified, 0.15).otherwise(0.0))


def fit_verdict(score: Column, verified: Column, threshold: float = 0.12) -> Column:
    """'keep' from the threshold on; where a prompt has no ``verified`` candidate at all, 'keep_raw_fit' from three quarters of it (0.06 at least)."""
    return F.when(score >= threshold, "keep").when(~verified & (score >= max(0.06, 0.75 * threshold)), "keep_raw_fit").otherwise("ignore")


def is_complete(title: Column, doi: Column, arxiv_id: Column, year: Column, venue: Column, abstract: Column, terms: Column, authors: Column) -> Column:
    """Whether a record may be kept without asking further sources."""
    full = lambda c: F.trim(text(c)) != ""
    return full(title) & ((bare_doi(doi) != "") | (bare_arxiv(arxiv_id) != "")) & ((digits_or_empty(year) != "") | full(venue)) & (full(abstract) | (terms > 0) | (authors > 0))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def is_target(url: Column, template: Column) -> Column:
    h = host_of(url)
    listed = F.exists(F.array(*[F.lit(d) for d in TARGET_DOMAINS]), lambda d: h.contains(d))
    return (h != "") & (listed | ((template == "scholar_graph") & h.contains(SCHOLAR_DOMAIN)))


def next_search(query: Column, fulfilled: Column, identifiers: Column, rows: Column) -> Column:
    """struct(move, query): tune, deepen, expand or stop."""
    move = F.when(~fulfilled, "tune").when(identifiers >= 3, "deepen").when(rows >= 5, "expand").otherwise("stop")
    then = F.when(~fulfilled, F.concat(query, F.lit(" paper DOI arXiv"))).when(identifiers >= 3, F.concat(query, F.lit(" related work"))).when(rows >= 5, F.concat(query, F.lit(" recent"))).otherwise("")
    return F.struct(move.alias("move"), F.trim(then).alias("query"))


def cycle_decision(workflow: Column, cycle: Column, most: Column, n_listed: Column, ignored: Column, same: Column) -> Column:
    """struct(move, reason, stop): what follows a cycle of the search loop."""
    needed = F.when((workflow == "theme_refine") & (most >= 2), 2).otherwise(1)
    case = lambda a, b, c: F.struct(F.lit(a).alias("move"), F.lit(b).alias("reason"), F.lit(c).alias("stop"))
    return (
        F.when((n_listed == 0) & (ignored > 0), case("stop", "needs_user_feedback", "needs_feedback"))
        .when(n_listed == 0, case("stop", "no_candidates", "no_candidates"))
        .when(cycle >= most, case("stop", "cycle_budget_reached", "max_cycles_reached"))
        .when(cycle < needed, case("continue", "minimum_refinement_cycles_not_met", ""))
        .when(same, case("stop", "converged_candidate_set", "converged"))
        .otherwise(case("continue", "refinement_budget_available", ""))
    )
