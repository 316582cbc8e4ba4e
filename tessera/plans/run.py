"""The whole way of a corpus: read, map, verify, lint, render, check. Each step is lazy; nothing is collected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import blocks, extract, lint, quality, verify
from tessera.plans import docx, render, state
from tessera.sources import load

#: How blocks become records; a user may add a function of the same form.
EXTRACTORS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"rules": extract.records}
FORMATS = ("txt", "md", "json", "yaml", "docx")


@dataclass(frozen=True)
class Outcome:
    """Tables by doc_id: records with what was unplaced and dropped, findings of all stages, states, and errors of sources that could not be read."""

    records: DataFrame
    findings: DataFrame
    passed: DataFrame
    errors: DataFrame


def headings_noted(records: DataFrame, config: Config) -> DataFrame:
    """Records with the source's own wording of its headings in `meta.headings`."""
    own = blocks.source_headings(load.blocks(records), config).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "heading"))).alias("tessera_headings"))
    meta = F.col("resume.meta").withField("headings", F.coalesce("tessera_headings", F.create_map().cast("map<string,string>")))
    return records.join(own, "doc_id", "left").withColumn("resume", F.col("resume").withField("meta", meta)).drop("tessera_headings")


def run(sources: DataFrame, config: Config | None = None, extractor: str = "rules") -> Outcome:
    """`sources` (doc_id, path, text) -> an outcome. Only documents that verify are rendered and checked; lint never stops one."""
    config = config or Config()
    if extractor not in EXTRACTORS:
        raise ValueError(f"extractor {extractor!r}: there are {', '.join(EXTRACTORS)}")
    docs = load.parsed(sources, config)
    errors = docs.where("error is not null").select("doc_id", "error")
    kept = blocks.without_dropped(docs.where("error is null"), config)
    records = headings_noted(EXTRACTORS[extractor](kept, config), config)
    invalid = records.where(F.size("problems") > 0).select("doc_id", F.lit("ingest").alias("stage"), F.lit("Schema").alias("name"), F.lit("fail").alias("status"), F.lit(None).cast("string").alias("location"), F.explode("problems").alias("detail"))
    verified = verify.verified(records, config)
    failures = invalid.unionByName(verified)
    passed = verify.rolled_up(records, failures).select("doc_id", "passed")
    good = records.join(passed.where("passed"), "doc_id", "left_semi")
    resume, parts = F.col("resume"), F.col("parts")
    shown = render.viewed(good, config).select("doc_id", "resume", render.headings(resume, parts=parts).alias("headings"), render.flat_items(resume, parts=parts).alias("expected"), render.rendered(resume, parts=parts).alias("text"))
    findings = failures.unionByName(lint.linted(records)).unionByName(quality.checked(shown, config))
    return Outcome(records, findings, passed, errors)


def rendered(records: DataFrame, config: Config | None = None, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """(doc_id, name, ...) with a column for each format asked for."""
    config = config or Config()
    if unknown := [f for f in formats if f not in FORMATS]:
        raise ValueError(f"formats {unknown}: there are {', '.join(FORMATS)}")
    resume, parts = F.col("resume"), F.col("parts")
    made = {"txt": render.rendered(resume, parts=parts), "md": render.rendered(resume, markdown=True, parts=parts), "json": render.json_resume(resume)}
    out = render.viewed(records, config).select("doc_id", render.output_name(resume["basics"]["name"], resume["meta"]["target_company"]).alias("name"), *(made[f].alias(f) for f in formats if f in made))
    for name, other in (("yaml", render.yaml_text), ("docx", docx.packages)):
        if name in formats:
            out = out.join(other(records), "doc_id")
    return out


def batch(spark: SparkSession, folder: str, config: Config | None = None) -> Outcome:
    """All files of a folder; a document's id is its path, so equal names in different folders stay apart."""
    files = load.files(spark, folder)
    return run(files.select(F.col("path").alias("doc_id"), "path", "text"), config)


def recorded(outcome: Outcome) -> DataFrame:
    """The verification state to keep, by the content of each record."""
    content = outcome.records.select("doc_id", F.to_json("resume").alias("content"))
    return state.recorded(content, outcome.passed)
