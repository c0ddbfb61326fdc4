"""The knowledge base: looking requests up in it, resolving what it lacks, and storing what was resolved.

All work on whole batches and give the next version of each table; a batch sees the
knowledge base as it was before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from . import dml
from .resolve import lookups, merged_by_identifier, with_lookup_ids

c = F.col
KEYS = {"papers": ["id"], "authors": ["id"], "orgs": ["id"], "bylines": ["paper_id", "author_id"], "metadata": ["paper_id", "author_id"], "author_orgs": ["author_id", "org_id"], "provenance": ["id"]}


def cached(requests: DataFrame, papers: DataFrame) -> DataFrame:
    """qid, found_by ('arxiv', 'doi', 'title', 'miss'), paper of requests (qid, doi, arxiv_url, arxiv_id, title).

    Of several papers (id, doi, arxiv_id, title, newest: what tells newer rows) of one identifier the newest
    counts, of equally new ones that with the smallest id; a title counts only if one paper alone has it.
    """
    q = with_lookup_ids(requests).select("qid", c("eff_doi").alias("qd"), c("eff_arxiv").alias("qa"), R.title_words(c("title")).alias("qt"))
    p = papers.select("id", "newest", R.bare_doi(c("doi")).alias("qd"), R.bare_arxiv(c("arxiv_id")).alias("a"), R.title_words(c("title")).alias("qt"))
    p = p.withColumn("qa", F.when(c("a") != "", c("a")).otherwise(R.alias_arxiv(c("qd"))))
    first = lambda key, out: p.where(c(key) != "").groupBy(key).agg(newest_first("id", "newest").alias(out), F.count(F.lit(1)).alias("n"))
    hit = q.join(first("qa", "pa").drop("n"), "qa", "left").join(first("qd", "pd").drop("n"), "qd", "left").join(first("qt", "pt").where("n = 1").drop("n"), "qt", "left")
    how = F.when(c("pa").isNotNull(), "arxiv").when(c("pd").isNotNull(), "doi").when(c("pt").isNotNull(), "title").otherwise("miss")
    return hit.select("qid", how.alias("found_by"), R.text(F.coalesce("pa", "pd", "pt")).alias("paper"))


def newest_first(what: str, newest: str) -> Column:
    """The value with the largest ``newest`` (a time; null is oldest), the smallest of equals."""
    return F.min_by(what, F.struct(-F.coalesce(F.unix_micros(c(newest).cast("timestamp")), F.lit(-(1 << 62))), c(what)))


def retrieve(requests: DataFrame, rows: DataFrame, papers: DataFrame, source_order: list[str], policy: str = "cache_first") -> DataFrame:
    """qid, status, reason, strategy and the record of each request that names an identifier or is stored.

    ``cache_first`` takes what the knowledge base has; what it lacks is resolved by the first source that knows
    it, and by all sources if that record isn't complete.  ``fast`` and ``consensus`` ask the sources only.
    Requests by title alone that aren't stored see ``resolve.resolve_titles``.
    """
    asked = lookups(requests)
    record = ["paper_id", "doi", "arxiv_id", "title", "year", "venue", "n_sources"]
    terms = rows.withColumn("_terms", F.size("keywords") + F.size("categories"))
    whole = merged_by_identifier(terms, "consensus", source_order).select("mode", "value", *record)
    if policy == "consensus":
        out = asked.where("mode in ('doi', 'arxiv')").join(whole, ["mode", "value"], "left").withColumn("strategy", F.lit("consensus"))
        return out.withColumns({"status": F.when(c("paper_id").isNotNull(), "resolved").otherwise("not_found"), "reason": c("strategy")}).drop("value")
    quick = merged_by_identifier(terms, "fast", source_order)
    full = R.is_complete(c("title"), c("doi"), c("arxiv_id"), c("year"), c("venue"), c("abstract"), c("n_terms"), F.lit(0))
    quick = quick.withColumn("full", full).select("mode", "value", "full", F.struct(*record).alias("quick"))
    found = asked.where("mode in ('doi', 'arxiv')").join(quick, ["mode", "value"], "left").join(whole.select("mode", "value", F.struct(*record).alias("whole")), ["mode", "value"], "left")
    fall = F.lit(policy == "cache_first") & c("quick").isNotNull() & ~F.coalesce("full", F.lit(False))
    found = found.select("qid", "mode", F.when(fall, c("whole")).otherwise(c("quick")).alias("r"), F.when(fall, "cache_miss_fast_incomplete_fallback_consensus").otherwise("fast").alias("strategy"))
    found = found.select("qid", "mode", "strategy", "r.*")
    if policy == "fast":
        return found.withColumns({"status": F.when(c("paper_id").isNotNull(), "resolved").otherwise("not_found"), "reason": c("strategy")})
    hits = cached(requests, papers).where("found_by != 'miss'").join(papers.select(c("id").alias("paper"), *[R.text(c(x).cast("string")).alias(f"_{x}") for x in ("doi", "arxiv_id", "title", "year", "venue")]), "paper")
    both = asked.select("qid", c("mode").alias("asked")).join(hits, "qid", "left").join(found, "qid", "left").where("paper is not null or mode is not null")
    stored = c("paper").isNotNull()
    pick = lambda x: F.when(stored, c(f"_{x}")).otherwise(R.text(c(x))).alias(x)
    return both.select(
        "qid", c("asked").alias("mode"), F.when(stored | c("paper_id").isNotNull(), "resolved").otherwise("not_found").alias("status"), F.when(stored, "cache_hit_db").otherwise(c("strategy")).alias("reason"),
        F.when(stored, "cache_hit").otherwise(c("strategy")).alias("strategy"), F.when(stored, c("paper")).otherwise(R.text(c("paper_id"))).alias("paper_id"), *[pick(x) for x in record[1:-1]],
        F.when(stored, 0).otherwise(F.coalesce("n_sources", F.lit(0))).cast("long").alias("n_sources"),
    )


def equivalent(records: DataFrame, entries: DataFrame) -> DataFrame:
    """qid, ord: the first entry (ord, doi, arxiv_id, title, year, venue) that is a record's paper (qid and the same fields).

    Same DOI, same arXiv id (also by alias), or title and year with venues that don't contradict.
    """

    def keyed(df: DataFrame, key: str) -> DataFrame:
        bare = df.select(key, R.bare_doi(c("doi")).alias("d"), R.bare_arxiv(c("arxiv_id")).alias("a"), R.title_words(c("title")).alias("t"), R.digits_or_empty(c("year")).alias("y"), R.title_words(c("venue")).alias("v"))
        return bare.withColumn("a", F.when(c("a") != "", c("a")).otherwise(R.alias_arxiv(c("d"))))

    q, e = keyed(records, "qid"), keyed(entries, "ord")
    first = lambda *k: e.where(" and ".join(f"{x} != ''" for x in k)).groupBy(*k).agg(F.min("ord").alias("ord"))
    by_id = q.where("d != ''").join(first("d"), "d").select("qid", "ord").unionByName(q.where("a != ''").join(first("a"), "a").select("qid", "ord"))
    # of a title and year the first entry of each venue is enough, so a title of very many entries is few rows
    venues = e.where("t != '' and y != ''").groupBy("t", "y", c("v").alias("ev")).agg(F.min("ord").alias("ord"))
    by_title = q.where("t != '' and y != ''").join(venues, ["t", "y"]).where("v = '' or ev = '' or v = ev").select("qid", "ord")
    return by_id.unionByName(by_title).groupBy("qid").agg(F.min("ord").alias("ord"))


def reconciled(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records with the id of the entry (ord, paper_id, ...) that is their paper, and its identifiers where they lack their own."""
    known = equivalent(records, entries).join(entries.select("ord", c("paper_id").alias("_id"), c("doi").alias("_doi"), c("arxiv_id").alias("_arxiv")), "ord").drop("ord")
    other = R.has(c("_id")) & (c("_id") != c("paper_id"))
    fill = lambda x, y: F.when(other & ~R.has(c(x)), R.text(c(y))).otherwise(c(x)).alias(x)
    joined = records.join(known, "qid", "left")
    swapped = {"paper_id": F.when(other, c("_id")).otherwise(c("paper_id")).alias("paper_id"), "doi": fill("doi", "_doi"), "arxiv_id": fill("arxiv_id", "_arxiv")}
    return joined.select(*[swapped.get(x, c(x)) for x in records.columns])


def upsert_entries(index: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """The index (paper_id, title, query_keys, source_count, policy, first_seen, last_seen) after resolved results in order of qid
    (qid, paper_id, title, query_key, paper_keys, n_sources, policy).

    The last result of a paper stays; a new entry starts with the key of its first query, and every later
    result adds its query and the paper's keys; the number of sources never falls.
    """
    old = index.select("paper_id", F.struct(*[x for x in index.columns if x != "paper_id"]).alias("o"))
    kept = ["title", "policy", "n_sources"]
    new = results.groupBy("paper_id").agg(
        F.max_by(F.struct(*kept), "qid").alias("n"), F.min("qid").alias("q0"), F.max("n_sources").alias("most"),
        F.collect_set("query_key").alias("asked"), F.collect_set(F.struct("qid", "paper_keys")).alias("keys"),
    )
    both = old.join(new, "paper_id", "full_outer")
    none = F.array().cast("array<string>")
    later = F.filter("keys", lambda k: c("o").isNotNull() | (k["qid"] > c("q0")))
    keys = F.array_sort(F.array_distinct(F.concat(F.coalesce("o.query_keys", none), F.coalesce("asked", none), F.coalesce(F.flatten(F.transform(later, lambda k: k["paper_keys"])), none))))
    fresh = c("n").isNotNull()
    return both.select(
        "paper_id", F.when(fresh, c("n.title")).otherwise(c("o.title")).alias("title"), keys.alias("query_keys"), F.greatest(F.coalesce("o.source_count", F.lit(0)), F.coalesce("most", F.lit(0))).cast("long").alias("source_count"),
        F.when(fresh, c("n.policy")).otherwise(c("o.policy")).alias("policy"), F.coalesce("o.first_seen", at).alias("first_seen"), F.when(fresh, at).otherwise(c("o.last_seen")).alias("last_seen"),
    )


def provenance_id(kind: Column, entity: Column, source: Column, key: Column) -> Column:
    return F.concat_ws("::", kind, entity, source, R.text(key))


def persisted(kb: dict[str, DataFrame], results: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The knowledge base after resolved results: papers and everyone named are stored, bylines replaced, provenance added.

    ``kb`` has papers (id, title, venue, year, doi, arxiv_id), authors (id, name, orcid), orgs (id, name, ror, country),
    bylines (paper_id, author_id, position), metadata (paper_id, author_id, source_ids, affiliations), author_orgs
    (author_id, org_id, role), provenance (id, entity_type, entity_id, source, source_key).  ``results`` has qid, paper_id,
    title, venue, year, doi, arxiv_id, authors (as ``merge.merge_authors`` gives them, in order); the last result of a
    paper stays.  ``sources`` has paper_id, source, source_key of the rows it was resolved from.

    Affiliations of an author of one paper at most are replaced, those of others added; those of an author who loses
    their last paper go.
    """
    last = results.groupBy("paper_id").agg(F.max_by(F.struct(*[x for x in results.columns if x not in ("qid", "paper_id")]), "qid").alias("r")).select("paper_id", "r.*")
    none = lambda x: F.nullif(R.text(c(x)), F.lit("")).alias(x)
    people = last.select("paper_id", F.posexplode("authors").alias("position", "a")).where("a.author_id != ''").select("paper_id", "position", "a.*")
    orgs = people.select("paper_id", "author_id", F.explode("affiliations").alias("o")).where("o.org_id != ''").select("paper_id", "author_id", "o.*")
    out = {"papers": dml.upsert(kb["papers"], last.select(c("paper_id").alias("id"), "title", "venue", F.when(R.digits_or_empty(c("year")) != "", c("year").cast("int")).alias("year"), none("doi"), none("arxiv_id")), "id", keep=())}
    pick = lambda df, key, *cols: df.groupBy(c(key).alias("id")).agg(F.max_by(F.struct(*cols), F.struct("paper_id", *[R.text(c(x)) for x in cols])).alias("r")).select("id", *[c(f"r.{x}").alias(x) for x in cols])
    out["authors"] = dml.upsert(kb["authors"], pick(people, "author_id", "name", "orcid").withColumn("orcid", F.nullif("orcid", F.lit(""))), "id", keep=())
    out["orgs"] = dml.upsert(kb["orgs"], pick(orgs, "org_id", "name", "ror", "country").select("id", "name", none("ror"), none("country")), "id", keep=())
    byline = people.groupBy("paper_id", "author_id").agg(F.max("position").alias("position"))
    out["bylines"] = dml.replace_children(kb["bylines"], byline, last, "paper_id")
    out["metadata"] = dml.replace_children(kb["metadata"], people.groupBy("paper_id", "author_id").agg(F.max_by("source_ids", "position").alias("source_ids"), F.max_by("affiliations", "position").alias("affiliations")), last, "paper_id")
    out["author_orgs"] = affiliations_after(kb["author_orgs"], orgs.select("author_id", "org_id").distinct(), people.select("author_id").distinct(), kb["bylines"].join(last.select("paper_id"), "paper_id", "left_semi"), out["bylines"])
    entry = lambda df, kind, entity, key, source=F.lit("resolver"): df.select(provenance_id(F.lit(kind), entity, source, key).alias("id"), F.lit(kind).alias("entity_type"), entity.alias("entity_id"), source.alias("source"), R.text(key).alias("source_key"))
    or_else = lambda *x: F.coalesce(*[F.nullif(R.text(y), F.lit("")) for y in x], F.lit(""))
    added = [
        entry(last, "paper", c("paper_id"), or_else(c("doi"), c("arxiv_id"), c("paper_id"))),
        entry(people, "author", c("author_id"), or_else(c("orcid"), F.array_join("source_ids", "|"), c("author_id"))),
        entry(people, "paper_author", F.concat_ws("::", "paper_id", "author_id"), c("position").cast("string")),
        entry(orgs, "org", c("org_id"), or_else(c("ror"), c("name"), c("org_id"))),
        entry(orgs, "author_org", F.concat_ws("::", "author_id", "org_id"), or_else(c("ror"), c("name"))),
        entry(sources.where("source != ''"), "paper", c("paper_id"), c("source_key"), c("source")),
    ]
    fresh = added[0]
    for x in added[1:]:
        fresh = fresh.unionByName(x)
    out["provenance"] = dml.upsert(kb["provenance"], fresh.dropDuplicates(["id"]), "id", keep=())
    return out


def affiliations_after(old: DataFrame, new: DataFrame, current: DataFrame, before: DataFrame, bylines: DataFrame) -> DataFrame:
    """author_id, org_id, role after a refresh: of ``current`` authors with one paper at most in ``bylines`` only the ``new``
    ones, of the others old and new ones; none of authors of the bylines ``before`` who have no paper left."""
    n = bylines.groupBy("author_id").agg(F.countDistinct("paper_id").alias("n"))
    replaced = current.join(n, "author_id", "left").where(F.coalesce("n", F.lit(0)) <= 1).select("author_id")
    gone = before.select("author_id").distinct().join(current, "author_id", "left_anti").join(n, "author_id", "left_anti")
    kept = old.join(replaced.unionByName(gone), "author_id", "left_anti")
    return kept.unionByName(new.join(kept, ["author_id", "org_id"], "left_anti").withColumn("role", F.lit(None).cast("string")), allowMissingColumns=True)


def without_papers(kb: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The knowledge base without the papers in ``gone`` (id): their bylines, metadata and provenance go, and that of their bylines."""
    ids = gone.select(c("id").alias("paper_id")).distinct()
    out = dict(kb) | {"papers": kb["papers"].join(gone.select("id").distinct(), "id", "left_anti")}
    for name in ("bylines", "metadata"):
        out[name] = kb[name].join(ids, "paper_id", "left_anti")
    owner = F.when(c("entity_type") == "paper", c("entity_id")).when(c("entity_type") == "paper_author", F.substring_index("entity_id", "::", 1))
    out["provenance"] = kb["provenance"].withColumn("paper_id", owner).join(ids, "paper_id", "left_anti").drop("paper_id")
    return out
