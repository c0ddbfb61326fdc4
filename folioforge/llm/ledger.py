"""Problem 1: duplicates hidden by formatting differences, by an incremental ledger.

The ledger holds one row a canonical key: number of copies, smallest id and earliest
representative, first and last time seen.  It is kept in hash buckets, each a
folder.  A new batch is aggregated by key first (map-side combine, so a key
that a third of all rows share is only a few rows when it is shuffled), then
full-outer-joined with the buckets that it touches; counts are added and the
earlier representative stays.  Untouched buckets are neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_doi, letters_and_digits
from ..functions.compose import composed
from ..operators.skew import attach_unique
from ..storage import Manifest, Scratch, names_in, remove
from .common import table

SCHEMA = "key string, n_copies long, first_id string, earliest struct<at: timestamp, id: string>, last_seen timestamp, version int, bucket int"
#: Stands for the time of rows without one: they are never the earliest beside rows with one.
NO_TIME = "9999-12-31"


def record_key(doi: Column, title: Column) -> Column:
    """The key of a record: its DOI (or that it has none) and its title's letters and digits.

    Null, empty and letterless titles have no key: they aren't counted as copies of each other.
    The key is a 128-bit hash, so wide titles don't travel through the shuffle.
    """
    title_key = letters_and_digits(composed(title))
    return F.when(title_key.isNotNull(), F.md5(F.concat(F.coalesce(canonical_doi(doi), F.lit("")), F.lit("\n"), title_key)))


class CopyLedger:
    """A bucketed ledger under ``root``; every update writes new files for touched buckets only.

    Which version of a bucket holds is said by a manifest, so a ledger that is opened again goes on from
    its last update.  An update counts once the manifest names its files, and only then the files it replaces go.
    """

    def __init__(self, spark: SparkSession, root: str, n_buckets: int):
        self.spark, self.root, self.manifest = spark, root, Manifest(spark, root)
        held = self.manifest.newest() or {"n_buckets": n_buckets, "version": 0, "batch": None, "buckets": {}}
        self.n_buckets, self.version, self.batch = held["n_buckets"], held["version"], held["batch"]
        self.version_of: dict[int, int] = {int(b): v for b, v in held["buckets"].items()}  # n_buckets entries at most

    def _read(self, buckets: list[int] | None = None) -> DataFrame:
        wanted = self.version_of if buckets is None else {b: self.version_of[b] for b in buckets if b in self.version_of}
        paths = [f"{self.root}/version={v}/bucket={b}" for b, v in sorted(wanted.items())]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.option("basePath", self.root).schema(SCHEMA).parquet(*paths)

    def table(self) -> DataFrame:
        """The newest state: key, n_copies, first_id (the smallest), earliest_id and first_seen (by time), last_seen."""
        seen = F.when(F.col("earliest.at") != F.lit(NO_TIME).cast("timestamp"), F.col("earliest.at"))
        return self._read().select("key", "n_copies", "first_id", F.col("earliest.id").alias("earliest_id"), seen.alias("first_seen"), "last_seen")

    def update(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Add a batch of rows with columns key, id, seen; rows with a null key are left out.

        Batches with an id are counted once: ids grow, and one that is no larger than the last is in already.
        """
        if batch_id is not None and self.batch is not None and batch_id <= self.batch:
            return
        version = self.version + 1
        time = F.coalesce("seen", F.lit(NO_TIME).cast("timestamp"))
        fresh = (
            batch.where(F.col("key").isNotNull()).groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min(F.struct(time.alias("at"), "id")).alias("e"), F.max("seen").alias("t1"))
            .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.n_buckets)).cast("int"))
        )
        scratch = Scratch(self.spark, "ledger-batch")
        if self.version_of:
            fresh = scratch.save(fresh, "fresh")
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # n_buckets values at most
            old = self._read(touched).drop("version")
            merged = old.join(fresh, ["bucket", "key"], "full_outer").select(
                "bucket", "key", (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_copies"),
                F.least("first_id", "id").alias("first_id"), F.least("earliest", "e").alias("earliest"), F.greatest("last_seen", "t1").alias("last_seen"),
            )
        else:
            merged = fresh.select("bucket", "key", F.col("n").alias("n_copies"), F.col("id").alias("first_id"), F.col("e").alias("earliest"), F.col("t1").alias("last_seen"))
        path = f"{self.root}/version={version}"
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        scratch.clear()
        written = [int(n.split("=")[1]) for n in names_in(self.spark, path) if n.startswith("bucket=")]
        replaced = {b: self.version_of[b] for b in written if b in self.version_of}
        batch_id = self.batch if batch_id is None else batch_id
        buckets = self.version_of | dict.fromkeys(written, version)
        self.manifest.commit({"n_buckets": self.n_buckets, "version": version, "batch": batch_id, "buckets": buckets})
        self.version, self.batch, self.version_of = version, batch_id, buckets
        for b, v in replaced.items():
            remove(self.spark, f"{self.root}/version={v}/bucket={b}")


def build_ledger(papers: DataFrame, n_buckets: int | None = None) -> tuple[CopyLedger, DataFrame, Scratch]:
    """Ledger over ``papers`` in two loads (rows before the median arrival, then the rest) and the keyed rows."""
    spark = papers.sparkSession
    scratch = Scratch(spark, "ledger")
    n_buckets = n_buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = scratch.save(
        papers.select(record_key(F.col("doi"), F.col("title")).alias("key"), "id", F.col("created_at").cast("timestamp").alias("seen")).where(F.col("key").isNotNull()), "keyed"
    )
    middle = keyed.select(F.percentile_approx(F.unix_micros("seen"), 0.5, 1000)).first()[0]
    early = F.coalesce(F.unix_micros("seen") < F.lit(middle if middle is not None else 0), F.lit(True))
    ledger = CopyLedger(spark, f"{scratch.root}/ledger", n_buckets)
    ledger.update(keyed.where(early))
    ledger.update(keyed.where(~early))
    return ledger, keyed, scratch


def copies(papers: DataFrame) -> DataFrame:
    """first_id, copy_id: every row that repeats an earlier one but for its writing.

    Null or letterless titles pair with nothing; repeated ids (there are none in a keyed
    table) would give one row each; an empty table gives no rows.
    """
    ledger, keyed, scratch = build_ledger(papers)
    groups = ledger.table().where("n_copies > 1").select("key", "first_id")
    return (
        attach_unique(keyed.select("key", "id"), groups, "key")
        .where(F.col("id") != F.col("first_id"))
        .select("first_id", F.col("id").alias("copy_id"))
    )


def copy_counts(papers: DataFrame) -> DataFrame:
    """first_id, n_copies: one row for each record, with the number of rows that repeat it (itself included)."""
    ledger, _, _ = build_ledger(papers)
    return ledger.table().select("first_id", "n_copies")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "papers"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_counts(table(spark, sf_dir, "papers"))
