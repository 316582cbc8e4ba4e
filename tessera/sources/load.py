"""Sources of any type -> blocks, one row a document, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera import schema
from tessera.config import Config
from tessera.sources import html, jsonresume, latex, markdown, plain

PARSERS = {"html": html.parse, "latex": latex.parse, "markdown": markdown.parse, "jsonresume": jsonresume.parse, "text": plain.parse}
# Suffix -> type; no reader for PDF is installed, so those are errors.
SUFFIXES = {".html": "html", ".htm": "html", ".tex": "latex", ".md": "markdown", ".markdown": "markdown", ".json": "jsonresume", ".txt": "text", ".pdf": "pdf"}
SKIPPED_FOLDERS = ("out", "node_modules")
WATCHED = (".html", ".tex")


def detected(path: Column, text: Column) -> Column:
    """The type of a source by its suffix, else by how its text begins; null if neither tells."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    by_suffix = F.try_element_at(F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair)), suffix)
    head = F.lower(F.substring(F.regexp_replace(text, r"^(?U)[\s\x1c-\x1f]+", ""), 1, 2000))
    by_text = (
        F.when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
        .when(head.contains("\\documentclass") | text.contains("\\begin{document}"), "latex")
        .when(head.startswith("{"), "jsonresume")
        .when(head.startswith("# "), "markdown")
    )
    return F.coalesce(by_suffix, by_text)


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = WATCHED) -> DataFrame:
    """(path, text, error) of the files below a folder, but for skipped and hidden folders; what is not UTF-8 is an error."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    inner = F.regexp_replace(F.col("path"), "^.*?" + "\\Q" + folder.rstrip("/").removeprefix("file://") + "\\E", "")
    parts = F.slice(F.split(inner, "/"), F.lit(1), F.greatest(F.size(F.split(inner, "/")) - 1, F.lit(0)))
    skipped = F.exists(parts, lambda p: p.isin(*SKIPPED_FOLDERS) | p.startswith("."))
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return read.where(wanted & ~skipped).select("path", F.when(good, F.col("content").cast("string")).alias("text"), F.when(~good, "not UTF-8 text").alias("error"))


def parsed(sources: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, type, blocks, links, error) for each row of `sources` (doc_id, path, text).

    A source that cannot be read has an error and no blocks: it never stops the others.
    """
    config = config or Config()
    rows = sources.select(F.col("doc_id").cast("string").alias("doc_id"), detected(F.col("path"), F.col("text")).alias("type"), "text")
    out = schema.struct(f"doc_id string, type string, blocks array<struct<{_colon(schema.BLOCK)}>>, links array<struct<{_colon(schema.LINK)}>>, error string")
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def one(kind: str | None, text: str | None) -> tuple[list, list, str | None]:
        if kind not in PARSERS or text is None:
            return [], [], f"unsupported input type: {kind or 'unknown'}" if text is not None else "no text"
        try:
            found = PARSERS[kind](text, config)
        except (ValueError, AttributeError, TypeError, KeyError, RecursionError) as problem:
            return [], [], f"{type(problem).__name__}: {problem}"
        return found.rows(), found.links, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(k.as_py(), t.as_py()) for k, t in zip(batch.column(1), batch.column(2), strict=True)]
            cols = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(cols, kinds[2:], strict=True))], out.names)

    return rows.mapInArrow(run, out)


def _colon(ddl: str) -> str:
    return ", ".join(x.replace(" ", ":", 1) for x in ddl.split(", "))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, ...) of each block of parsed documents."""
    return docs.select("doc_id", F.posexplode("blocks").alias("seq", "block")).select("doc_id", "seq", "block.*")
