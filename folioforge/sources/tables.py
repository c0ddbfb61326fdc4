"""Artifact tables: tab-separated files as Python's csv writes them, and their older layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMAT = {"sep": "\t", "header": "true", "lineSep": "\r\n", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns in order, lists joined by pipes without blanks, missing values empty."""
    kinds = dict(df.dtypes)

    def cell(name: str):
        if name not in kinds:
            return F.lit("").alias(name)
        if kinds[name].startswith("array"):
            return F.array_join(F.filter(name, lambda x: F.trim(x.cast("string")) != ""), "|").alias(name)
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    df.select(*[cell(x) for x in columns or df.columns]).write.mode("overwrite").options(**_FORMAT).csv(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Files of this or an older layout: columns they lack are empty."""
    # missing values stand as nothing between tabs, so what is read as null is the empty text
    found = spark.read.options(**{k: v for k, v in _FORMAT.items() if k != "nullValue"}).csv(path)
    return found.select(*[F.coalesce(F.col(x), F.lit("")).alias(x) if x in found.columns else F.lit("").alias(x) for x in columns])
