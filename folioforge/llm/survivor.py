"""Problem 4: the best representative of each duplicate group, field by field.

The fields are unpivoted to long rows; every value votes with the trust in its
source times a decay with its age; votes are summed by normalised value, the
value with most of them wins, and the winners are pivoted back into one record
a group.  Only values fit to win vote: identifiers that are some, venues that
are no placeholders, and complete abstracts (not missing, cut, a placeholder or
a site notice; see ``truncation``).

Sums are combined before the shuffle, so a group that holds a third of all rows
arrives as a few rows a task; joins are on unique ids.

Defined results: rows in no group give nothing; a field of which no value may
vote is null; equal votes go to the value whose first row has the smallest id;
a row without source or time votes with the lowest trust or as an old one;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_arxiv, canonical_doi
from ..storage import Scratch
from .common import table
from .consolidate import groups
from .truncation import judged

#: Trust in a row's source if none is given: publishers' feeds before catalogues before the web.
TRUST = {"xref": 1.0, "librarysync": 0.9, "preprints": 0.9, "openindex": 0.8, "scholargraph": 0.7, "webmeta": 0.5}
OTHER_TRUST = 0.3
#: After so many days a vote counts half; rows without a time count as if they were OLDEST_DAYS old.
HALF_LIFE_DAYS, OLDEST_DAYS = 730.0, 3650.0
#: Values that stand for no venue.
NO_VENUE = ("n/a", "na", "-", "none", "unknown", "tba", "tbd", "to appear", "preprint", "self-published", "null")
FIELDS = ("abstract", "venue", "doi", "arxiv_id")


def ballots(papers: DataFrame, member: DataFrame, trusted: dict[str, float] | None = None) -> DataFrame:
    """group_id, id, weight, and the normalised value of each field, null where it may not vote.

    ``member`` has group_id, id; ``trusted`` gives the trust in each source (others have OTHER_TRUST).  Abstracts are one value if they say the same: labels, markup,
    rights lines and how they are written don't make another one.
    """
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (trusted or TRUST).items() for x in kv]), F.col("source")), F.lit(OTHER_TRUST))
    day = F.unix_micros(F.greatest(F.col("updated_at").cast("timestamp"), F.col("created_at").cast("timestamp"))) / F.lit(86_400e6)
    now = papers.agg(F.max(day)).first()[0]  # one number, against which ages count
    weight = trust * F.pow(F.lit(0.5), F.coalesce(F.lit(now) - day, F.lit(OLDEST_DAYS)) / F.lit(HALF_LIFE_DAYS))
    complete = judged(papers.select("id", "source", F.col("abstract").alias("text"), "title"), True).where("verdict = 'whole'").select("id", F.col("essence").cast("string").alias("abstract"))
    venue = F.trim(F.regexp_replace(F.lower("venue"), r"[\s\p{Z}]+", " "))
    rows = papers.select(
        "id", weight.alias("weight"),
        F.when((venue != "") & ~venue.isin(*NO_VENUE) & ~venue.contains("://"), F.regexp_replace(venue, r"[^\p{L}\p{N}]+", " ")).alias("venue"),
        canonical_doi(F.col("doi")).alias("doi"), canonical_arxiv(F.col("arxiv_id")).alias("arxiv_id"),
    )
    return member.join(rows, "id").join(complete, "id", "left")


def tally(cast: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """group_id, field, norm, first_id, votes."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("norm")) for f in fields]))
    return (
        cast.select("group_id", "id", "weight", stack.alias("v")).where("v.norm is not null")
        .groupBy("group_id", "v.field", "v.norm").agg(F.min("id").alias("first_id"), F.sum("weight").alias("votes"))
    )


def winners(counted: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """group_id and one column a field: the first row with the value that got most votes."""
    best = F.min_by("first_id", F.struct(-F.round("votes", 9), F.col("first_id")))
    return counted.groupBy("group_id").pivot("field", list(fields)).agg(best)


def best_records(papers: DataFrame, pairs: DataFrame, trusted: dict[str, float] | None = None) -> DataFrame:
    """group_id, the surviving abstract, venue, doi and arxiv_id, and the id of the row each comes from."""
    scratch = Scratch(papers.sparkSession, "survivor")
    member = scratch.save(groups(papers, pairs), "groups")
    won = scratch.save(winners(tally(ballots(papers, member, trusted), FIELDS), FIELDS), "won")
    long = won.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("id")) for f in FIELDS])).alias("v"))
    values = papers.select("id", *[F.col(f).alias(f"{f}_value") for f in FIELDS])
    picked = (
        long.select("group_id", "v.field", "v.id").where("id is not null").join(values, "id")
        .select("group_id", "field", F.coalesce(*[F.when(F.col("field") == f, F.col(f"{f}_value")) for f in FIELDS]).alias("value"))
    )
    wide = picked.groupBy("group_id").pivot("field", list(FIELDS)).agg(F.first("value"))
    return won.select("group_id", *[F.col(f).alias(f"{f}_id") for f in FIELDS]).join(wide, "group_id", "left").select("group_id", *FIELDS, *[f"{f}_id" for f in FIELDS])


def completed(papers: DataFrame, pairs: DataFrame, trusted: dict[str, float] | None = None) -> DataFrame:
    """group_id, abstract_id of groups with a complete abstract and at least one row without."""
    scratch = Scratch(papers.sparkSession, "survivor")
    member = scratch.save(groups(papers, pairs), "groups")
    cast = scratch.save(ballots(papers, member, trusted).select("group_id", "id", "weight", "abstract"), "ballots")
    lacking = cast.where("abstract is null").select("group_id").distinct()
    return (
        winners(tally(cast, ("abstract",)), ("abstract",)).join(lacking, "group_id", "left_semi")
        .select("group_id", F.col("abstract").alias("abstract_id"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completed(table(spark, sf_dir, "papers"), table(spark, sf_dir, "match_pairs"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_records(table(spark, sf_dir, "papers"), table(spark, sf_dir, "match_pairs"))
