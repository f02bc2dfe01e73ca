"""Session helpers and durable intermediate tables.

Iterative operators cut their lineage by writing a table under the checkpoint folder. Such a table
survives the loss of executors, is read back with column pruning and filter pushdown, and can be
dropped as soon as a newer state replaces it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lexigrain", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="lexigrain-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_scopes: list[list["StoredTable"]] = []


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Drops all tables stored inside when it ends, for runs that leave their results elsewhere.

    Tables stored outside stay until they are dropped, as the frames that read them may be used later.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            table.drop()


class StoredTable:
    """A DataFrame written once under the checkpoint folder and read back from there."""

    def __init__(self, df: DataFrame, label: str):
        spark = df.sparkSession
        self.path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        if _scopes:
            _scopes[-1].append(self)

    def keep(self) -> "StoredTable":
        """Leaves the table to the enclosing scope, if there is one."""
        if _scopes and self in _scopes[-1]:
            _scopes[-1].remove(self)
            if len(_scopes) > 1:
                _scopes[-2].append(self)
        return self

    def drop(self) -> None:
        """Delete the files once nothing reads them any more."""
        remove(self.df.sparkSession, self.path)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the checkpoint folder and return the stored copy."""
    return StoredTable(df, label).df


def _filesystem(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, location = _filesystem(spark, path)
    return fs.exists(location)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, location = _filesystem(spark, path)
    return fs.exists(location) and fs.getFileStatus(location).isFile()


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, location = _filesystem(spark, source)
    if not fs.rename(location, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file over another one in a single step, so readers see the old one or the new one."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration()).getUri(),
        spark._jsc.hadoopConfiguration(),
    )
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(source), location, how)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder."""
    fs, location = _filesystem(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(location)]


def remove(spark: SparkSession, path: str) -> None:
    fs, location = _filesystem(spark, path)
    fs.delete(location, True)


def require_empty_directory(spark: SparkSession, path: str) -> None:
    """Results go to a directory that is missing or empty; nothing is ever overwritten."""
    fs, location = _filesystem(spark, path)
    if not fs.exists(location):
        return
    if not fs.getFileStatus(location).isDirectory():
        raise ValueError(f"results need a folder, but {path} is a file")
    if len(fs.listStatus(location)):
        raise ValueError(f"the folder {path} holds files already")


def require_new_path(spark: SparkSession, path: str) -> None:
    if path_exists(spark, path):
        raise ValueError(f"there is something at {path} already")


def write_one_file(df: DataFrame, path: str) -> None:
    """Write a one-column, few-row text DataFrame as a single file, visible only when complete."""
    spark = df.sparkSession
    staging = f"{path}.part-{uuid.uuid4().hex}"
    df.coalesce(1).write.text(staging)
    fs, location = _filesystem(spark, staging)
    names = [status.getPath().toString() for status in fs.listStatus(location)]
    move(spark, next(n for n in names if n.rsplit("/", 1)[-1].startswith("part-")), path)
    remove(spark, staging)
