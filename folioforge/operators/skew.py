"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 500
#: Parts into which the rows of a hot key are split.
HOT_PARTS = 48


def _splits_skew(rows: DataFrame) -> bool:
    """Whether the session splits skewed partitions of a join while it runs."""
    conf = rows.sparkSession.conf
    return all(conf.get(k, "true").lower() == "true" for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"))


def attach_unique(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``unique`` (one row a key) on ``key``, balanced if keys of ``rows`` are hot.

    The rows of a hot key fill one partition of the shuffle; adaptive execution splits it by map
    outputs and gives every piece the few rows of ``unique`` that belong to it, which costs nothing
    where no key is hot.  In a session without it hot keys are counted and salted (``salted``).
    Rows whose key is null find no partner.
    """
    return rows.join(unique, key, how) if _splits_skew(rows) else salted(rows, unique, key, how)


def salted(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The same join by counting hot keys first and splitting their rows into HOT_PARTS parts.

    Hot keys are those with at least HOT_SHARE of the rows, hence no more than 1 / HOT_SHARE of
    them: this is the proven bound of the one table broadcast here.  Both tables are read more
    than once and should be written tables.
    """
    least = max(1000, int(rows.count() * HOT_SHARE))
    hot = F.broadcast(rows.groupBy(key).count().where((F.col("count") >= least) & F.col(key).isNotNull()).select(F.col(key).alias("_hot_key")))
    left = rows.join(hot, rows[key] == hot["_hot_key"], "left").withColumn(
        "_salt", F.when(F.col("_hot_key").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot_key")
    right = unique.join(hot, unique[key] == hot["_hot_key"], "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot_key")
    return left.join(right, [key, "_salt"], how).drop("_salt")
