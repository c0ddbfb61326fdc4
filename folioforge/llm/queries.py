"""Queries of this package for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import consolidate, entity_match, ledger, mixing, spelling, stuffing, survivor, sql, tokenize, truncation, venues


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": ledger.p1_found,
        "p1_counts": ledger.p1_counts,
        "p2_found": entity_match.p2_found,
        "p2_matches": entity_match.p2_matches,
        "p3_found": truncation.p3_found,
        "p3_rates": truncation.p3_rates,
        "p4_found": survivor.p4_found,
        "p4_records": survivor.p4_records,
        "p5_found": venues.p5_found,
        "p5_unmatched": venues.p5_unmatched,
        "p5_within": venues.p5_within,
        "p6_found": consolidate.p6_found,
        "p7_found": spelling.p7_found,
        "p7_members": spelling.p7_members,
        "p8_ids": tokenize.p8_ids,
        "p9_mix": mixing.p9_mix,
        "p9_shares": mixing.p9_shares,
        "p10_found": stuffing.p10_found,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
