"""Tables that cut lineage: Parquet in the folder that driver and executors share, removed when the driver ends or by hand."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all runs in one process (tests), a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="keyloom-")
        shared_folder.own = folder
    return folder.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/keyloom-table-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(forget)
    _FOLDERS[path] = spark
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and read back from a table."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_table = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove a table that nothing reads any more."""
    path = getattr(df, "_keyloom_table", None)
    if path in _FOLDERS:
        _remove(path, _FOLDERS.pop(path))


def forget() -> None:
    for path in list(_FOLDERS):
        try:
            _remove(path, _FOLDERS.pop(path))
        except Exception:  # noqa: BLE001 - the session may have ended
            continue


def _remove(path: str, spark: SparkSession) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
