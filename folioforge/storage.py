"""Tables kept between the steps of iterative operators.

Lineage is cut by writing a table into the folder that the session names in
``spark.checkpoint.dir`` (shared by all executors), so a lost executor never
loses a step.  Only where that setting is absent, as in local tests, a
temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, without a trailing slash."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def _folder(spark: SparkSession, path: str):
    """(path, file system) of the JVM."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of what lies in a folder; none if it is missing."""
    target, fs = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


class Manifest:
    """State of a table that is kept in versions, as numbered small files of which the newest holds.

    A state counts from the moment its file is renamed into place, so after a crash the former one
    holds still; whoever opens the folder goes on from there.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/manifest"

    def newest(self) -> dict | None:
        names = [n for n in names_in(self.spark, self.root) if n.endswith(".json")]
        if not names:
            return None
        target, fs = _folder(self.spark, f"{self.root}/{names[-1]}")
        stream = fs.open(target)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, state: dict) -> None:
        """Make ``state`` the one that holds; the one before it stays, older ones go."""
        names = [n for n in names_in(self.spark, self.root) if n.endswith(".json")]
        number = int(names[-1].split(".")[0]) + 1 if names else 0
        draft, fs = _folder(self.spark, f"{self.root}/draft-{uuid.uuid4().hex[:12]}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not fs.rename(draft, _folder(self.spark, f"{self.root}/{number:012d}.json")[0]):
            raise OSError(f"state {number} could not be put in place under {self.root}")
        for n in names[:-1]:
            remove(self.spark, f"{self.root}/{n}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it names; a missing path is no error."""
    target, fs = _folder(spark, path)
    fs.delete(target, True)


def _forget_local() -> None:
    """Scratch folders on a local disk go with the process; those on other file systems are the cluster's to clean."""
    for root in _ROOTS:
        if root.startswith(("file:", "/")):
            shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


#: Bytes of a plan's inputs that one partition of its shuffles stands for, and partitions a core at least.
SHUFFLE_BYTES, SHUFFLES_A_CORE = 8 << 20, 2
#: Plans take an input of unknown size for one of about 2^63 bytes.
_UNKNOWN = 1 << 60
_SIZED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def input_bytes(df: DataFrame) -> int:
    """Bytes of what a plan reads, as far as they are known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < _UNKNOWN)


def parts_by_size(df: DataFrame, bytes_each: int) -> int:
    """Partitions for work that is heavy by byte: as many as the inputs' size asks for, and two a core at least."""
    return max(SHUFFLES_A_CORE * df.sparkSession.sparkContext.defaultParallelism, min(input_bytes(df) // bytes_each, 100_000))


@contextmanager
def sized_shuffles(df: DataFrame) -> Iterator[None]:
    """Shuffles of ``df``, run inside, get partitions by the size of its inputs instead of a fixed number.

    A fixed number is too small for large inputs and costs every task a file a partition on small ones;
    adaptive execution joins what turns out small.  A number that the session itself sets stays.
    """
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    if conf.contains(_SIZED) or conf.contains("spark.sql.shuffle.partitions"):
        yield
        return
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= _UNKNOWN:
        yield
        return
    least = SHUFFLES_A_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set(_SIZED, str(min(max(least, size // SHUFFLE_BYTES), 100_000)))
    try:
        yield
    finally:
        spark.conf.unset(_SIZED)


_ROOTS: list[str] = []
atexit.register(_forget_local)


class Scratch:
    """Intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/folioforge/{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append(self.root)
        self._n = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, tag: str = "t", partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return it as read from the written files."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with sized_shuffles(df):
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def seen_as(self, saved: DataFrame, view: DataFrame) -> DataFrame:
        """``view``, made of the written table ``saved`` alone, known by that table's files."""
        view._scratch_path = saved._scratch_path  # type: ignore[attr-defined]
        return view

    def clear(self) -> None:
        """Delete all tables."""
        remove(self.spark, self.root)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                remove(self.spark, path)
