"""Canonical forms of identifiers and titles that are written in many ways.

All builders take and return Columns; null in gives null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A DOI: registrant code, slash, suffix without blanks, query or fragment; punctuation at its end isn't part of it.
DOI_PATTERN = r"""(10\.[0-9]{4,9}/[^?#<>\s]*[^?#<>\s.,;:)\]}"'])"""
_ARXIV_ID = r"[0-9]{4}\.[0-9]{4,5}|[a-z][a-z-]*(?:\.[a-z]{2})?/[0-9]{7}"
#: An arXiv id: new style, or archive and seven digits; the version is left out.
ARXIV_PATTERN = rf"^(?:arxiv:|(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/)?({_ARXIV_ID})(?:v[0-9]+)?(?:\.pdf)?(?:[?#].*)?$"
ARXIV_ALIAS = "10.48550/arxiv."
_BLANK = r"[\s\p{Z}\p{Cf}]+"

# Every builder is one chain in which each step is used once, so that no step is worked out
# twice wherever the optimizer puts it; ``nullif`` keeps its operand in a projection of its own.


def _tight(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), _BLANK, "")


def canonical_doi(value: Column) -> Column:
    """The DOI in lower case without resolver, label, brackets or query; null if the value holds none.

    >>> "HTTPS://DOI.ORG/10.99062/S01-24?via=feed" -> "10.99062/s01-24"; "10.", "n/a", "" -> null
    """
    found = F.regexp_extract(F.replace(_tight(value), F.lit("%2f"), F.lit("/")), DOI_PATTERN, 1)
    return F.nullif(F.regexp_replace(found, r"^(10\.48550/arxiv\..*)v[0-9]+$", "$1"), F.lit(""))


def canonical_arxiv(value: Column) -> Column:
    """The arXiv id without prefix, address, version or fragment; null if the value is no such id.

    >>> "http://arxiv.org/pdf/1702.30111v2.pdf" -> "1702.30111"; "arXiv:", "pending" -> null
    """
    return F.nullif(F.regexp_extract(_tight(value), ARXIV_PATTERN, 1), F.lit(""))


def arxiv_of_doi(doi: Column) -> Column:
    """The arXiv id that a canonical DOI is the alias of, else null."""
    return F.nullif(F.regexp_extract(doi, rf"^10\.48550/arxiv\.({_ARXIV_ID})(?:v[0-9]+)?(?:\.pdf)?$", 1), F.lit(""))


def letters_and_digits(text: Column) -> Column:
    """Lower-cased letters and digits in their order, accents kept; null if none is left.

    The text must be in composed form (see ``compose``).
    """
    return F.nullif(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), F.lit(""))
