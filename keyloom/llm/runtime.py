"""Session settings, shared scratch tables and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch hands to Python; texts are long, so far fewer than Spark's default.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
#: Tasks for each core that write a scratch table, and partitions that one of them takes at most (each file costs a round trip to the file system).
TASKS_A_CORE, FILES_IN_ONE = 12, 4
#: Seconds after which the gateway's worker, which wakes once a second, has passed on what Python let go.
GATEWAY_PAUSE = 1.5
#: What Python workers start with: freed memory of Arrow and numpy goes back to the system, not into pools of their own.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20)}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers (texts may be very long), and let workers find this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) >= 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def trim() -> None:
    """Hand freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on an iterator of batches; its worker process lives on after the task, but keeps no freed memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(shared_folder, "own", None)
        if folder is None:
            folder = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive the loss of an executor.

    Results read them, so what no operator drops earlier goes by ``forget`` or when the driver ends.
    """

    roots: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/keyloom-{name}-{uuid.uuid4().hex}"
        self.count = 0
        if not Scratch.roots:
            atexit.register(Scratch.forget)
        Scratch.roots[self.root] = spark

    @classmethod
    def forget(cls, since: set[str] = frozenset()) -> None:
        """Remove the tables of all operators but those named in ``since``: nothing that read them is used any more."""
        for root in [r for r in cls.roots if r not in since]:
            try:
                delete(cls.roots.pop(root), root)
            except Exception:  # noqa: BLE001 - the session may have ended
                continue

    def save(self, df: DataFrame) -> DataFrame:
        """Write a table; a task writes one file for several small partitions, but never for more than FILES_IN_ONE of them."""
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        most = max(TASKS_A_CORE * self.spark.sparkContext.defaultParallelism, -(-shuffle_width(self.spark) // FILES_IN_ONE))
        df.coalesce(most).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._keyloom_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that nothing reads any more."""
        path = getattr(df, "_keyloom_path", None)
        if path:
            delete(self.spark, path)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more; it learns of them by garbage collection."""
        gc.collect()
        for _ in range(2):  # what Python let go is held on the JVM's side until the gateway's worker wakes, and some of it until a second collection
            time.sleep(GATEWAY_PAUSE)
            self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df`` (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def global_rank(scratch: Scratch, df: DataFrame, order: list, rank: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Number the rows of ``df`` from 0 in the order of ``order``, without a single-task sort.

    A range-partitioned sort fixes every row's partition and place in it; only one count per
    partition reaches the driver. Returns the ranked rows and the table to drop when done.
    """
    spark = df.sparkSession
    (mark,) = fresh(df, "mark")
    n = parts or shuffle_width(spark)
    # monotonically_increasing_id is the partition in the upper 31 bits and the place in the lower 33
    kept = scratch.save(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()))
    part, place = F.shiftright(mark, 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r[0]: r[1] for r in kept.groupBy(part.alias("p")).count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    base = F.lit(0).cast("long") if not starts else F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), (part + 1).cast("int"))
    return kept.withColumn(rank, base + place).drop(mark), kept
