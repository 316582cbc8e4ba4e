"""Tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Whether Spark deletes the shuffle files of an action at its end, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where it is unset, a temporary one on a single machine (tests), and an error on a cluster, whose machines would not share it."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all machines of the cluster share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: the lineage ends there, so a lost executor costs no earlier work."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Tables saved inside are deleted at its end, but for those that are taken out of the list."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for table in _scopes.pop():
            dropped(table)


def released(tables: list[DataFrame], *needed: DataFrame) -> None:
    """Take what a result still reads out of the list of `temporary`."""
    tables[:] = [x for x in tables if not any(x is y for y in needed)]


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside, on tables defined inside, delete their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from `saved` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.tessera_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
