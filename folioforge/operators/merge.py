"""Ranking, deduplication and merging of candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as R
from ..storage import Scratch

c = F.col


def best_first(score: Column, doi: Column, arxiv_id: Column, title: Column) -> list[Column]:
    """The order of preference: score, has a DOI, has an arXiv id, longer title; all descending."""
    return [score, R.has(doi).cast("int"), R.has(arxiv_id).cast("int"), F.length(title)]


def dedup(rows: DataFrame, key: str = "key") -> DataFrame:
    """The row with the highest score of each key, the first one of equals; ``first_ord`` is where the key first came up.

    Aggregates instead of a window, so rows of a hot key are combined before the shuffle.
    """
    kept = [x for x in rows.columns if x != key]
    best = F.max_by(F.struct(*kept), F.struct(c("score"), -c("ord"))).alias("row")
    return rows.groupBy(key).agg(best, F.min("ord").alias("first_ord")).select(key, "row.*", "first_ord")


def ranked(rows: DataFrame, key: str = "key", within: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Deduplicated rows with ``rank``; ties stay in the order in which their keys came up."""
    order = [x.desc() for x in best_first(c("score"), c("doi"), c("arxiv_id"), c("title"))] + [c("first_ord").asc()]
    if not within:
        out = ranked_all(dedup(rows, key), order)
    else:
        out = dedup(rows, key).withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(*order)).cast("long"))
    return out if most is None else out.where(c("rank") <= most)


def top_candidates(rows: DataFrame, most: int, key: str = "key") -> DataFrame:
    """The ``most`` best candidates with their rank: a distributed top-k first, so only k rows meet in one task."""
    order = [x.desc() for x in best_first(c("score"), c("doi"), c("arxiv_id"), c("title"))] + [c("first_ord").asc()]
    head = dedup(rows, key).orderBy(*order).limit(most)
    return head.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def merge_rows(rows: DataFrame, by: str) -> DataFrame:
    """One record a group: smallest identifiers and year, title, venue and address of the best row, longest abstract."""
    order = F.struct(R.has(c("doi")).cast("int"), R.has(c("arxiv_id")).cast("int"), c("score"), F.length("title"), -c("ord"))
    best = F.max_by(F.struct("title", "venue", "url"), order)
    abstract = F.trim(c("abstract"))
    merged = rows.groupBy(by).agg(
        F.min(F.nullif(R.bare_doi(c("doi")), F.lit(""))).alias("doi"), F.min(F.nullif(R.bare_arxiv(c("arxiv_id")), F.lit(""))).alias("arxiv_id"),
        F.min(F.nullif(F.trim("year"), F.lit(""))).alias("year"), best.alias("best"),
        F.max_by(F.when(abstract != "", abstract), F.when(abstract != "", F.struct(F.length(abstract), -c("ord")))).alias("abstract"),
    )
    out = merged.select(by, *[R.text(c(x)).alias(x) for x in ("doi", "arxiv_id", "year", "abstract")], "best.*")
    return out.withColumn("paper_id", R.paper_id(c("doi"), c("arxiv_id"), c("title"), c("year")))


def merge_terms(rows: DataFrame, by: str, field: str, most: int = R.MAX_TERMS) -> DataFrame:
    """The first ``most`` different terms of a group in order of rows and places, first spelling kept.

    Repeats are dropped by an aggregate before terms are put in order.
    """
    each = rows.select(by, "ord", F.posexplode(field).alias("pos", "term")).withColumn("term", F.trim("term")).where(c("term") != "")
    first = each.groupBy(by, F.lower("term").alias("low")).agg(F.min(F.struct("ord", "pos", "term")).alias("at"))
    place = F.row_number().over(W.partitionBy(by).orderBy("at.ord", "at.pos"))
    return (
        first.withColumn("place", place).where(c("place") <= most).groupBy(by)
        .agg(F.array_sort(F.collect_list(F.struct("place", c("at.term").alias("term")))).alias("l"))
        .select(by, F.transform("l", lambda x: x["term"]).alias(field))
    )


def merge_authors(rows: DataFrame, by: str) -> DataFrame:
    """by, author_id, name, orcid, source_ids, affiliations of the authors of a group's rows (by, ord, source, authors).

    An author is who has one stable id.  Name and ORCID are the first that are known, source ids and
    affiliations each different one in the order of rows and places; affiliations have their organisation's id.
    Aggregated in two steps, so an author of very many rows is combined before the shuffle.
    """
    each = rows.select(by, "ord", "source", F.posexplode("authors").alias("pos", "a"))
    each = each.select(by, "ord", "pos", "source", "a.*").withColumn(
        "author_id", R.author_id(c("name"), c("orcid"), c("source_id"), F.when(R.has(c("source")), c("source")).otherwise("unknown"), F.transform("affiliations", lambda x: x["name"])))
    at = F.struct("ord", "pos")
    known = lambda x: F.min_by(x, F.when(c(x) != "", at))
    heads = each.groupBy(by, "author_id").agg(known("name").alias("name"), known("orcid").alias("orcid"))
    in_order = lambda what: F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(what).alias("v")))), lambda x: x["v"]).alias(what)
    ids = each.where("source_id != ''").groupBy(by, "author_id", c("source_id").alias("source_ids")).agg(F.min(at).alias("at")).groupBy(by, "author_id").agg(in_order("source_ids"))
    places = each.select(by, "author_id", "ord", "pos", "source", F.posexplode("affiliations").alias("place", "o"))
    org = F.struct(R.org_id(c("o.name"), c("o.ror"), c("source")).alias("org_id"), "o.name", "o.ror", "o.country")
    orgs = places.groupBy(by, "author_id", org.alias("affiliations")).agg(F.min(F.struct("ord", "pos", "place")).alias("at")).groupBy(by, "author_id").agg(in_order("affiliations"))
    none = lambda x, like: F.coalesce(x, F.array().cast(dict(like.dtypes)[x])).alias(x)
    return heads.join(ids, [by, "author_id"], "left").join(orgs, [by, "author_id"], "left").select(by, "author_id", R.text(c("name")).alias("name"), R.text(c("orcid")).alias("orcid"), none("source_ids", ids), none("affiliations", orgs))


def ranked_all(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their place in ``order`` (which must tell any two apart), without bringing them into one task.

    Rows are range-partitioned by the order and written; each partition counts its own, and the
    counts of the partitions before it, one row a partition, are added.
    """
    scratch = Scratch(rows.sparkSession, "ranked")
    parts = scratch.save(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parts")
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, (c("_own") + c("_before")).cast("long")).drop("_part", "_own", "_before")


def canonical_clusters(rows: DataFrame, cluster: str) -> DataFrame:
    """One record a cluster of discovery rows: smallest identifiers, longest title, smallest year,
    source of the smallest row key, smallest venue and address."""
    least = lambda x: R.text(F.min(F.nullif(x, F.lit("")))).alias
    doi, arxiv = R.bare_doi(c("doi")), R.bare_arxiv(c("arxiv_id"))
    out = rows.groupBy(cluster).agg(
        least(doi)("doi"), least(arxiv)("arxiv_id"), least(c("year"))("year"), least(c("venue"))("venue"), least(c("url"))("url"),
        F.min_by("title", F.struct(-F.length("title"), c("title"))).alias("title"), F.min_by(F.struct("source", "source_id"), F.struct("row_key", "ord")).alias("first"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return out.select(cluster, "doi", "arxiv_id", "year", "venue", "url", "title", "first.*", "n_rows").withColumn("paper_id", R.paper_id(c("doi"), c("arxiv_id"), c("title"), c("year")))
