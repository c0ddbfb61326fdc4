"""Fuzzy join of titles of one year.

The measure is the ratio of matching blocks of two strings, 2 M / (a + b).  Two
lossless bounds are applied in Spark before it: lengths, and the multiset of
characters; equal titles need no measure.  Only different titles are compared,
and pairs are met through shared pieces: with a ratio of r at least, no more than
(1 - r)(a + b) characters are unmatched, so of that many pieces plus one at
least one stands unchanged in the other title.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

RATIO = 0.94
#: Bins of the character multiset: letters, blank, other.
_BINS = "abcdefghijklmnopqrstuvwxyz "


def histogram(title: Column) -> Column:
    """Counts of each letter, of blanks and of all other characters."""
    counts = [F.length(title) - F.length(F.replace(title, F.lit(ch), F.lit(""))) for ch in _BINS]
    return F.array(*counts, F.length(F.translate(title, _BINS, "")))


def shared_characters(a: str, b: str) -> Column:
    """How many characters two titles (columns hist_a, hist_b) share, wherever they stand."""
    return F.aggregate(F.zip_with(f"hist_{a}", f"hist_{b}", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def may_match(a: str, b: str, ratio: float = RATIO) -> Column:
    """Whether lengths and characters (columns len_a, hist_a, len_b, hist_b) allow the ratio."""
    la, lb = F.col(f"len_{a}"), F.col(f"len_{b}")
    return (2.0 * F.least(la, lb) / (la + lb) >= ratio) & (2.0 * shared_characters(a, b) / (la + lb) >= ratio)


def piece_size(n: Column, ratio: float = RATIO) -> Column:
    """Length of a title's pieces: one piece more than characters that can be unmatched.

    Both titles together have n + m characters, and m is at most n * (2 - ratio) / ratio.
    """
    unmatched = F.floor((1 - ratio) * 2 * n / ratio)
    return F.greatest(F.floor(n / (unmatched + 1)), F.lit(1)).cast("int")


def pieces(title: Column, ratio: float = RATIO) -> Column:
    """structs at, piece: the title cut into pieces one of which stands unchanged in any title that fits."""
    n = F.length(title)
    size = piece_size(n, ratio)
    return F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int") - 1), lambda i: F.struct((i * size + 1).alias("at"), F.substring(title, i * size + 1, size).alias("piece")))


def probes(title: Column, ratio: float = RATIO) -> Column:
    """structs at, piece: all stretches of the title that can be a piece of one that fits."""
    n = F.length(title)
    shortest, longest = F.floor(n * ratio / (2 - ratio)).cast("int"), F.ceil(n * (2 - ratio) / ratio).cast("int")
    sizes = F.array_distinct(F.transform(F.sequence(F.greatest(shortest, F.lit(1)), longest), lambda k: piece_size(k, ratio)))
    fits = F.filter(sizes, lambda k: k <= n)
    return F.flatten(F.transform(fits, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.struct(at.alias("at"), F.substring(title, at, k).alias("piece")))))


def similar_titles(rows: DataFrame, ratio: float = RATIO) -> DataFrame:
    """a, b: edges between rows (ord, title_norm, year) of one year with similar titles.

    Rows of equal title and year are linked to the first of them; different titles by the first
    rows that have them, compared in order of arrival (the measure isn't symmetric).

    Pieces travel as numbers with the titles' lengths and their places; what stands before a shared
    piece differs by no more characters than can be unmatched.  Texts are joined to the pairs left.

    Joins are hinted: sizes are estimated by the width of rows, as if a title had one piece and a
    histogram one bin, and millions of pieces would be gathered on the driver to be broadcast.
    """
    scratch = Scratch(rows.sparkSession, "similar")
    own = scratch.save(rows.where("title_norm != '' and year != ''").select("ord", "title_norm", "year"), "titles")
    distinct = scratch.save(own.groupBy("year", "title_norm").agg(F.min("ord").alias("first")), "distinct")
    equal = own.join(distinct, ["year", "title_norm"]).where("ord != first").select(F.col("first").alias("a"), F.col("ord").alias("b"))

    def side(x: str, cut: Column) -> DataFrame:
        each = distinct.select("first", "year", F.length("title_norm").alias("len"), F.explode(cut).alias("p"))
        return each.select(F.xxhash64("year", "p.piece").alias("piece"), F.col("first").alias(f"first_{x}"), F.col("len").alias(f"len_{x}"), F.col("p.at").alias(f"at_{x}"))

    met = side("a", pieces(F.col("title_norm"), ratio)).join(side("b", probes(F.col("title_norm"), ratio)).hint("merge"), "piece")
    both = F.col("len_a") + F.col("len_b")
    near = (2.0 * F.least("len_a", "len_b") >= ratio * both) & (F.abs(F.col("at_a") - F.col("at_b")) <= F.floor((1 - ratio) * both + 1e-9))
    pairs = scratch.save(met.where((F.col("first_a") != F.col("first_b")) & near).select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")).distinct(), "pairs")
    t = distinct.select("first", "year", "title_norm", F.length("title_norm").alias("len"), histogram(F.col("title_norm")).alias("hist"))
    texts = lambda x: t.select(*[F.col(k).alias(f"{k}_{x}") for k in ("first", "year", "title_norm", "len", "hist")]).hint("merge")
    pairs = pairs.join(texts("a"), F.col("a") == F.col("first_a")).join(texts("b"), F.col("b") == F.col("first_b"))
    pairs = pairs.where((F.col("year_a") == F.col("year_b")) & may_match("a", "b", ratio)).select("a", "b", F.col("title_norm_a").alias("ta"), F.col("title_norm_b").alias("tb"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = [SequenceMatcher(None, p, q).ratio() >= ratio for p, q in zip(x["ta"], x["tb"])]
            yield x.loc[keep, ["a", "b"]]

    return equal.unionByName(pairs.mapInPandas(measure, "a long, b long"))
