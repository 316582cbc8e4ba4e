"""Removal of repeated passages of lines, in DataFrame functions only.

How it scales: a window of three lines travels as two 64-bit hashes. A first aggregation, combined on the map side, finds the hashes that occur twice; only windows
with such a hash keep their place and meet the first place of their hash. Each document gets one array of positions back. A window that fills a third of the corpus
is one row a task in each aggregation. Both joins have a stored table on either side, so that an adaptive plan broadcasts the small one or splits a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import dropped, saved

#: Lines of a window.
LINES = 3


def _size(column: str) -> Column:
    return F.when(F.col(column).isNull(), 0).otherwise(F.size(column))


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, one, two, at): both hashes of the lines at, at + 1, ... of each text."""
    lines = docs.select("doc_id", "text_hash", F.split("text", "\n").alias("lines")).where(F.size("lines") >= LINES)
    hashed = lines.select("doc_id", "text_hash", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit(LINES), x)).alias("b"))
    each = lambda i: F.struct(*(F.xxhash64(*(F.get(c, i + k) for k in range(LINES))).alias(n) for c, n in (("a", "one"), ("b", "two"))), i.alias("at"))
    return hashed.select("doc_id", "text_hash", F.inline(F.transform(F.sequence(F.lit(0), F.size("a") - LINES), each)))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, covered) of documents that lose lines: the positions, from 0, that later occurrences of a window cover."""
    windows = _windows(docs)
    often = saved(windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two"), "often")
    again = saved(windows.join(often, ["one", "two"]).select("one", "two", F.struct("doc_id", "text_hash", "at").alias("place")), "windows")
    dropped(often)
    first = saved(again.groupBy("one", "two").agg(F.min("place").alias("first")), "first")
    later = again.join(first, ["one", "two"]).where("place > first")
    starts = later.groupBy("place.doc_id", "place.text_hash").agg(F.collect_set("place.at").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + LINES - 1))))
    return starts.select("doc_id", "text_hash", covered.alias("covered"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with `text` less its removed lines, and with n_lines and n_removed (int).

    Lines end at \\n. A window is three lines in a row; its first occurrence, by doc_id, then by a hash of the text, then by place, stays, and what later ones
    cover goes. So a removed line has an equal one that stays. Defined cases: a null text stays null, with 0 lines; a text of fewer than three lines has no
    window; an empty text is one empty line; null doc_ids come first; rows equal in doc_id and text are one document, and get the same text; ties cannot be, as a
    place occurs once; an empty table gives no rows; columns n_lines and n_removed that were there are replaced.
    """
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    docs = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"), F.struct(*names).alias("row"))
    gone = removed_lines(docs).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "covered")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    out = out.withColumn("lines", F.split("text", "\n"))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered"))
    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.select(*(F.col("row")[c].alias(c) for c in names), text.alias("text"), _size("lines").alias("n_lines"), _size("covered").alias("n_removed"))


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY ls[i], ls[i + 1], ls[i + 2] ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT spot) AS covered FROM (SELECT doc_id, i + unnest(range(3)) AS spot FROM later) GROUP BY doc_id)
SELECT doc_id, CASE WHEN covered IS NULL THEN text
    ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda x: NOT list_contains(covered, x)), lambda x: ls[x]), chr(10)) END AS text,
  coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(len(covered), 0)::INTEGER AS n_removed
FROM d LEFT JOIN gone USING (doc_id)
"""
