"""Watching folders: a streaming source of new and changed files, each passed on once it has held still."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tessera.sources.load import SKIPPED_FOLDERS, WATCHED


def found_files(folders: list[str]) -> dict[str, int]:
    """Path -> time of change in nanoseconds, of files that are watched; one that goes away meanwhile is left out."""
    out = {}
    for folder in folders:
        for where, names, files in os.walk(folder):
            names[:] = [n for n in names if n not in SKIPPED_FOLDERS and not n.startswith(".")]
            for name in files:
                if name.lower().endswith(WATCHED):
                    try:
                        out[os.path.join(where, name)] = os.stat(os.path.join(where, name)).st_mtime_ns
                    except OSError:
                        continue
    return out


class FolderReader(SimpleDataSourceStreamReader):
    """Offsets hold what was seen and what is settling: files there at the start are seen; a change is passed on when a later look finds the same time."""

    def __init__(self, folders: list[str], interval: float):
        self.folders, self.interval = folders, interval

    def initialOffset(self) -> dict:
        return {"seen": found_files(self.folders), "settling": {}, "at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["at"] and (wait := start["at"] + self.interval - time.time()) > 0:
            time.sleep(min(wait, self.interval))
        seen, settling, ready = dict(start["seen"]), {}, []
        for path, stamp in sorted(found_files(self.folders).items()):
            if seen.get(path) == stamp:
                continue
            if start["settling"].get(path) == stamp:
                seen[path] = stamp
                ready.append((path, stamp))
            else:
                settling[path] = stamp
        return iter(ready), {"seen": seen, "settling": settling, "at": time.time()}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(sorted((p, t) for p, t in end["seen"].items() if start["seen"].get(p) != t))


class FolderSource(DataSource):
    """`spark.readStream.format("folders").option("folders", "a:b").option("interval", 1.0)`: (path, stamp) of files as they settle."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "path string, stamp long"

    def simpleStreamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["folders"].split(":"), float(self.options.get("interval", "1.0")))


def watch(spark: SparkSession, folders: list[str], handle: Callable[[DataFrame], None], checkpoint: str, interval: float = 1.0):
    """Start a query that calls `handle` with (path, text, error) of files as they settle. A failing batch is reported and does not stop the stream."""
    missing = [f for f in folders if not os.path.isdir(f)]
    if missing:
        raise ValueError(f"no such folders: {missing}")
    spark.dataSource.register(FolderSource)

    def batch(files: DataFrame, number: int) -> None:
        paths = [r.path for r in files.select("path").collect()]  # a batch is what changed in an interval
        rows = []
        for path in paths:
            try:
                with open(path, encoding="utf-8") as f:
                    rows.append((path, f.read(), None))
            except (OSError, UnicodeDecodeError) as problem:
                rows.append((path, None, f"{type(problem).__name__}: {problem}"))
        if rows:
            try:
                handle(files.sparkSession.createDataFrame(rows, "path string, text string, error string"))
            except Exception as problem:  # noqa: BLE001  one file must not stop the others
                print(f"batch {number}: {type(problem).__name__}: {problem}")

    stream = spark.readStream.format("folders").option("folders", ":".join(folders)).option("interval", str(interval)).load()
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
