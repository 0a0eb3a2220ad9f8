"""Tables staged in the folder that all executors share.

A staged table cuts lineage, survives the loss of an executor, and gives a later join two plain
shuffles, which adaptive execution can split where a key is hot.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder (local masters only)."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="planwright-")
    return _own[app]


def _folder(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)"""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, for tables of one job; Spark removes it when it ends."""
    path = f"{shared_dir(spark)}/planwright/{name}-{uuid.uuid4().hex}"
    where, files = _folder(spark, path)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it back."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; Spark removes it when it ends."""
    path = new_folder(df.sparkSession, name)
    out = written(df, path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing is going to read again."""
    where, files = _folder(df.sparkSession, df.staged_path)
    files.delete(where, True)
