"""Verification state by content: what passed, what was edited since, what failed, what was never looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def recorded(docs: DataFrame, passed: DataFrame) -> DataFrame:
    """(doc_id, sha256, passed): the state to write for `docs` (doc_id, content) and `passed` (doc_id, passed)."""
    return docs.select("doc_id", digest(F.col("content")).alias("sha256")).join(passed.select("doc_id", "passed"), "doc_id")


def states(docs: DataFrame, record: DataFrame) -> DataFrame:
    """(doc_id, state) of `docs` (doc_id, content) by a `record` (doc_id, sha256, passed)."""
    known = record.select("doc_id", "sha256", "passed")
    joined = docs.select("doc_id", digest(F.col("content")).alias("now")).join(known, "doc_id", "left")
    state = F.when(F.col("passed").isNull(), "unverified").when(~F.col("passed"), "failed").when(F.col("sha256") == F.col("now"), "passed").otherwise("edited")
    return joined.select("doc_id", state.alias("state"))


def latest(findings: DataFrame, order: str) -> DataFrame:
    """Findings of the last run of each document and stage."""
    last = findings.groupBy("doc_id", "stage").agg(F.max(order).alias(order))
    return findings.join(last, ["doc_id", "stage", order])
