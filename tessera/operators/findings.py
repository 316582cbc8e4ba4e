"""Findings of expressions and of Python from one pass over documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("name", "status", "location", "detail")
KIND = "array<struct<name:string,status:string,location:string,detail:string>>"


def together(docs: DataFrame, found: Column, inputs: list[str], look: Callable[[dict], Iterable[tuple[str, str, str | None, str]]]) -> DataFrame:
    """(doc_id, name, status, location, detail): `found`, an array of such structs, and what `look` yields from a row's `inputs`.

    Both in one pass, so that what `docs` comes from, such as parsing, runs once and not for each of them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                rows += [(row["doc_id"], *(x[n] for n in NAMES)) for x in row["found"]]
                rows += [(row["doc_id"], *x) for x in look(row)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["doc_id", *NAMES])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(found.cast(KIND), F.array().cast(KIND)).alias("found"), *inputs)
    return rows.mapInArrow(run, ", ".join(f"{n} string" for n in ("doc_id", *NAMES)))
