"""Structured Streaming twins of the append-only logs: windowed counts and latest-wins tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dml import latest
from ..storage import Manifest, Scratch, names_in, remove

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """Files of a folder (or one file) as a stream of events."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def event_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by type and window; events later than ``late`` behind the newest are left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


class LatestTable:
    """A table of the latest row of each key, moved forward by each micro-batch of a stream.

    Every batch is merged with the newest version into a new one, which counts once the manifest
    names it; only then the former one goes.  A batch that is run again after a failure gives the
    same version, one that is in already changes nothing, and a table opened again goes on from where it was.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], order: list[str]):
        self.spark, self.root, self.key, self.order = spark, root, key, order
        self.manifest = Manifest(spark, root)
        self.state = self.manifest.newest() or {"version": -1, "batch": -1}

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.state["batch"]:
            return
        fresh = latest(batch, self.key, self.order)
        if self.state["version"] >= 0:
            fresh = latest(self.table().unionByName(fresh), self.key, self.order)
        new = {"version": self.state["version"] + 1, "batch": batch_id}
        fresh.write.mode("overwrite").parquet(f"{self.root}/v={new['version']}")
        self.manifest.commit(new)
        self.state = new
        for name in names_in(self.spark, self.root):
            if name.startswith("v=") and name != f"v={new['version']}":
                remove(self.spark, f"{self.root}/{name}")

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.state['version']}")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there now, then stop; the checkpoint lets a later run go on from here."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_events(spark: SparkSession, path: str) -> DataFrame:
    """The last event of each user and type, by way of a stream over the files at ``path``."""
    scratch = Scratch(spark, "latest-events")
    state = LatestTable(spark, f"{scratch.root}/table", ["user_id", "event_type"], ["ts", "event_id"])
    run_available(read_events(spark, path), state.apply, f"{scratch.root}/checkpoint")
    return state.table()
