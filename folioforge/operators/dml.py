"""Changes to tables as DataFrame to DataFrame functions; the result is the table's next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with their key, nulls too; only ``keep`` stays as it was."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    fresh = F.coalesce("n._new", F.lit(False))
    pick = lambda x: F.coalesce(F.col(f"o.{x}"), F.col(f"n.{x}")) if x in keep else F.when(fresh, F.col(f"n.{x}")).otherwise(F.col(f"o.{x}"))
    return o.join(n, key, "full_outer").select(key, *[pick(x).alias(x) for x in old.columns if x != key])


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; combined before the shuffle, so a hot key is no burden."""
    kept = [x for x in rows.columns if x not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("row")).select(*key, "row.*")


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """All children of ``parents`` go, ``new`` come."""
    return old.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables without the rows that refer to the keys in ``gone``; tables are given with their reference column."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return {name: t.join(ids, t[ref] == ids["_gone"], "left_anti") for name, (t, ref) in tables.items()}
