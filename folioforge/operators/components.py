"""Connected components by Boruvka hooking with pointer doubling.

Every round, each component hooks onto the other end of its smallest outgoing
edge (edges ordered by their two labels, so no two are equal and hooks can only
form trees with one two-cycle at the root, which the smaller label breaks),
trees collapse by pointer doubling, and edges are relabelled and deduplicated
until none is left.  At least halves the number of components a round.
All steps are joins on written tables; nothing is gathered to the driver but
counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import Scratch
from .skew import attach_unique

#: Parts of a key's rows in the first of two steps that link them to their smallest id.
STAR_PARTS = 64


def star_edges(members: DataFrame, key: str, node: str) -> DataFrame:
    """Edges a, b that connect all nodes of each key, without pairs inside a key.

    Each key's rows are split into STAR_PARTS parts by a hash of the node; a part's nodes
    are linked to the part's smallest one, and these, at most STAR_PARTS a key, to the key's.
    """
    # sorts by a number decide before texts of one beginning are compared
    m = members.select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(node).alias("n")).where("k is not null and n is not null")
    m = m.withColumn("part", F.pmod(F.xxhash64("n"), F.lit(STAR_PARTS)).cast("int"))
    inner = m.withColumn("low", F.min("n").over(W.partitionBy("h", "part", "k")))
    tops = inner.where("n = low").select("h", "k", "low").distinct()
    outer = tops.withColumn("first", F.min("low").over(W.partitionBy("h", "k")))
    return (
        inner.select(F.col("low").alias("a"), F.col("n").alias("b"))
        .unionByName(outer.select(F.col("first").alias("a"), F.col("low").alias("b")))
        .where("a != b")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component for every node of ``edges`` (columns a, b); component is the smallest node.

    A tree of hooks has its smallest node at its root: that node's smallest neighbour has no smaller
    one than it, so these two form the tree's two-cycle.  Roots are relabelled by roots, so the last
    one is the smallest of the component.

    Loops, repeated and reversed edges and nulls do no harm; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    label_type = dict(edges.dtypes)["a"]
    live = scratch.save(_tidy(edges.select("a", "b")), "edges")
    hooks: list[DataFrame] = []  # one table node -> root a round
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        parent = _collapse(scratch, _hook(live))
        hooks.append(parent)
        half = attach_unique(live, parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        both = attach_unique(half.select("ra", "b"), parent.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        new = scratch.save(_tidy(both.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        scratch.drop(live)
        live = new
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    if not hooks:
        return spark.createDataFrame([], f"node {label_type}, component {label_type}")
    # labels of a round's roots are the next round's nodes: compose from the last round down
    total = hooks[-1]
    for earlier in reversed(hooks[:-1]):
        up = total.select(F.col("node").alias("root"), F.col("root").alias("top"))
        total = scratch.save(attach_unique(earlier, up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
    return total.select("node", F.col("root").alias("component"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hook(edges: DataFrame) -> DataFrame:
    """node, root: the other end of the node's smallest edge, which is its smallest neighbour.

    With edges ordered as (smaller label, larger label) a node's smallest edge leads to its
    smallest neighbour, whether or not that one is smaller than the node itself.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("a").alias("root"))))
    return edges.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.root").alias("root"))


def _collapse(scratch: Scratch, hooks: DataFrame) -> DataFrame:
    """Two-cycles broken at their smaller end, then pointer doubling until every node points at its tree's root."""
    parent = scratch.save(hooks, "hooks")
    joined = attach_unique(parent, parent.select(F.col("node").alias("root"), F.col("root").alias("above")), "root")
    new = scratch.save(joined.select("node", F.when(F.col("above") == F.col("node"), F.least("node", "root")).otherwise(F.col("root")).alias("root")), "trees")
    scratch.drop(parent)
    while True:
        parent = new
        joined = attach_unique(parent, parent.select(F.col("node").alias("root"), F.col("root").alias("above")), "root")
        new = scratch.save(joined.select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "doubled")
        scratch.drop(parent)
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        new = scratch.seen_as(new, new.select("node", "root"))
