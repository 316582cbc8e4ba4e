"""A cleaning pipeline over `documents`: rules, repeated lines, near duplicates, benchmark leaks, then packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of `documents`. `run` writes each stage's rows
to the shared folder and reads them again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from tessera.llm.queries import table, tokenizer_path
from tessera.llm.store import dropped, saved


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with doc_id in place of a key of id and text, ids that are null last: it tells apart a document that has no id, or shares its id with another text."""
    key = F.struct(F.col("doc_id").isNull().alias("bare"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    return docs.select(key.alias("doc_id"), "text")


def _row(key: str) -> Column:
    """Whether a row of `docs` has the key in that column; each part is compared by itself, so that plans can join by them."""
    return F.col("doc_id").eqNullSafe(F.col(f"{key}.id")) & F.xxhash64("text").eqNullSafe(F.col(f"{key}.text"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """`docs` less the rows whose key is in `rejected` (doc_id)."""
    rejected = rejected.select(F.col("doc_id").alias("rejected")).distinct()
    return docs.join(rejected, _row("rejected"), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their text less later occurrences of three-line windows, and n_chars to match; rows left without a word go."""
    names = docs.columns
    out = line_dedup.deduplicated(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts of similarity 0.8 or more: that with the smallest doc_id, one without an id only if none has one; of repeated rows one."""
    found = near_dedup.near_duplicates(_keyed(docs), percent=80)
    kept = _without(docs, found.where("not kept"))
    again = saved(found.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again"), "again")
    if not again.limit(1).count():
        return kept
    return kept.join(again, _row("again"), "left_anti").unionByName(kept.join(again, _row("again"), "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return _without(docs, decontaminate.contaminated(_keyed(docs), table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in sequences."""
    return packing.packed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]
#: SQL cannot express near duplicates by sketches, tilings and packings; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
            if k:
                dropped(before)  # its successor is a table of its own
    return docs
