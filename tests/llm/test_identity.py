"""Problems 1, 4 and 6 on small tables, and against SQL."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioforge.llm import consolidate, ledger, queries, survivor
from folioforge.storage import Scratch
from tests.crosscheck import compare, connect

SF = "/root/testdata/sf0.001"
PAPER = "id string, source string, title string, venue string, doi string, arxiv_id string, abstract string, created_at timestamp, updated_at timestamp"


def papers(spark, rows):
    full = [{"id": None, "source": "xref", "title": None, "venue": None, "doi": None, "arxiv_id": None, "abstract": None, "created_at": datetime(2020, 1, 1), "updated_at": None} | r for r in rows]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in PAPER.split(", ")) for r in full], PAPER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) is None


def test_copies(spark):
    p = papers(spark, [
        {"id": "b", "title": "Map  SCANS!", "doi": "10.1234/X"}, {"id": "a", "title": "map scans", "doi": "https://doi.org/10.1234/x"}, {"id": "c", "title": "map scans", "doi": None},
        {"id": "d", "title": "Café", "doi": "n/a"}, {"id": "e", "title": "café"}, {"id": "f", "title": "cafe"}, {"id": "g", "title": " !!"}, {"id": "h"}, {"id": "i", "title": ""},
    ]).withColumn("key", F.lit("clash")).withColumn("bucket", F.lit(1))
    assert sorted(map(tuple, ledger.copies(p).collect())) == [("a", "b"), ("d", "e")]
    assert ledger.copies(papers(spark, [])).count() == 0
    assert {r.first_id: r.n_copies for r in ledger.copy_counts(p).collect()} == {"a": 2, "c": 1, "d": 2, "f": 1}


def test_ledger_touches_only_buckets_of_the_batch(spark):
    book = ledger.CopyLedger(spark, f"{Scratch(spark, 'test').root}/l", 8)
    rows = lambda *r: spark.createDataFrame([(k, i, datetime(2020, 1, d)) for k, i, d in r], "key string, id string, seen timestamp")
    book.update(rows(*[(f"k{i}", f"p{i:02d}", 2) for i in range(40)]))
    before = dict(book.version_of)
    book.update(rows(("k3", "a", 1), ("k3", "z", 3), (None, "n", 1)))
    assert sum(before[b] != v for b, v in book.version_of.items()) == 1
    got = {r.key: r for r in book.table().collect()}
    assert len(got) == 40 and (got["k3"].n_copies, got["k3"].first_id, got["k3"].first_seen.day, got["k3"].last_seen.day) == (3, "a", 1, 3)


def test_ledger_lasts(spark):
    root = f"{Scratch(spark, 'test').root}/l"
    rows = lambda *r: spark.createDataFrame([(k, i, datetime(2020, 1, d) if d else None) for k, i, d in r], "key string, id string, seen timestamp")
    first, second = rows(("k1", "b", 2), ("k1", "c", 1), ("k2", "d", None)), rows(("k1", "a", 3), ("k3", "e", 1))
    ledger.CopyLedger(spark, root, 8).update(first, 0)
    book = ledger.CopyLedger(spark, root, 4)  # another process; buckets are those of the ledger
    assert book.table().count() == 2 and book.n_buckets == 8
    book.update(second, 1)
    book.update(second, 1)  # the same batch again
    # a crash between writing an update and naming it: its files are no part of the ledger
    rows(("k2", "x", 1)).selectExpr("key", "5L n_copies", "id first_id").write.parquet(f"{root}/version={book.version + 1}/bucket=0")
    again = ledger.CopyLedger(spark, root, 8)
    again.update(rows(("k4", "f", 1)), 2)
    got = {r.key: (r.n_copies, r.first_id, r.earliest_id) for r in again.table().collect()}
    assert got == {"k1": (3, "a", "c"), "k2": (1, "d", "d"), "k3": (1, "e", "e"), "k4": (1, "f", "f")}
    whole = ledger.CopyLedger(spark, f"{root}-whole", 8)
    whole.update(first.unionByName(second).unionByName(rows(("k4", "f", 1))))
    assert sorted(map(tuple, whole.table().collect()), key=str) == sorted(map(tuple, again.table().collect()), key=str)


def test_groups_chain_and_ignore_junk(spark):
    p = papers(spark, [
        {"id": "p1", "doi": "10.1234/a"}, {"id": "p2", "doi": "DOI: 10.1234/A", "arxiv_id": "2001.00001v2"}, {"id": "p3", "arxiv_id": "https://arxiv.org/abs/2001.00001"},
        {"id": "p4", "doi": "10.48550/arXiv.2001.00001"}, {"id": "p5"}, {"id": "p6", "doi": "10."}, {"id": "p7", "doi": "10."}, {"id": "p8", "doi": "unknown"},
    ])
    pairs = spark.createDataFrame([("p5", "p4"), ("p8", "p8"), ("p8", "gone"), (None, "p7"), ("p4", "p5")], "left_id string, right_id string")
    assert sorted(map(tuple, consolidate.groups(p, pairs).collect())) == [("p1", f"p{i}") for i in range(1, 6)]


FULL = "We study the parsing of map scans in three archives. The method needs no tuning and works on old maps. Results are released with the scans."


def test_surviving_record(spark):
    filler = [{"id": f"x{i}", "doi": f"10.1234/x{i}", "title": f"t{i}", "abstract": f"Archive number {w} was measured twice in spring. It works on old maps. All is released with the scans."} for i, w in enumerate("one two three four five six".split())]
    p = papers(spark, [
        {"id": "a", "doi": "10.1234/q", "source": "webmeta", "abstract": FULL[:60], "venue": "preprint", "arxiv_id": "2001.00009"},
        {"id": "b", "doi": "10.1234/Q", "source": "xref", "abstract": f"<p>{FULL}</p>", "venue": "Annals of Maps"}, {"id": "c", "doi": "10.1234/q", "source": None, "abstract": "Abstract: " + FULL, "venue": "annals of  maps"},
        {"id": "d", "doi": "10.1234/q", "venue": "Other Annals", "source": "webmeta"}, {"id": "lone", "abstract": FULL}, *filler,
    ])
    none = spark.createDataFrame([], "left_id string, right_id string")
    assert [tuple(r) for r in survivor.completed(p, none).collect()] == [("a", "b")]
    r = survivor.best_records(p, none).where("group_id = 'a'").first()
    assert (r.abstract_id, r.venue, r.doi_id, r.arxiv_id) == ("b", "Annals of Maps", "a", "2001.00009")
    assert survivor.completed(papers(spark, []), none).count() == 0
