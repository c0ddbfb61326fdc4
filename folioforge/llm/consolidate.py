"""Problem 6: consolidating pairwise matches into groups.

Rows of one DOI, one arXiv id or one matched pair are edges; groups are the
components of that graph, found by Boruvka hooking (operators.components).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, star_edges
from .common import identifier_keys, table


def match_edges(papers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges a, b between papers ids: same DOI, same arXiv id (also through a DOI alias), or a row of pairs.

    Identifiers that are none, nulls, pairs of a row with itself and pairs with ids that
    papers lacks link nothing.
    """
    keys = identifier_keys(papers, "id")
    known = papers.select("id")
    given = (
        pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).where("a != b").distinct()
        .join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    )
    return star_edges(keys, "key", "id").unionByName(given.select("a", "b"))


def groups(papers: DataFrame, pairs: DataFrame) -> DataFrame:
    """group_id, id for every papers row that is linked to another one; group_id is the smallest id of the group."""
    return connected_components(match_edges(papers, pairs)).select(F.col("component").alias("group_id"), F.col("node").alias("id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "papers"), table(spark, sf_dir, "match_pairs"))
