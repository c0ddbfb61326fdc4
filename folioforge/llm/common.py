"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import arxiv_of_doi, canonical_arxiv, canonical_doi


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifier_keys(rows: DataFrame, node: str) -> DataFrame:
    """node, key: what a row (node, doi, arxiv_id) can be linked by, one row an identifier.

    A DOI that is the alias of an arXiv id has that id's key; values that are no identifiers give none.
    """
    bare = rows.select(node, canonical_doi(F.col("doi")).alias("doi"), canonical_arxiv(F.col("arxiv_id")).alias("arxiv"))
    return keys_of_canonical(bare, node)


def keys_of_canonical(bare: DataFrame, node: str) -> DataFrame:
    """The same of rows whose identifiers (doi, arxiv) are canonical already."""
    by_doi = F.coalesce(F.concat(F.lit("a"), arxiv_of_doi(F.col("doi"))), F.concat(F.lit("d"), "doi"))
    keys = bare.select(node, by_doi.alias("by_doi"), F.concat(F.lit("a"), "arxiv").alias("by_arxiv"))
    return keys.select(node, F.explode(F.array("by_doi", "by_arxiv")).alias("key")).where("key is not null")
