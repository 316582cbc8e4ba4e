"""Checks of text that was extracted from a rendering, against the record it was rendered from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import STANDARD_HEADINGS, Config
from tessera.functions.similarity import best_window
from tessera.functions.text import EMAIL, PHONE, PROPER_NOUN, display_url, glyphs, normalize, tech_tokens
from tessera.operators.findings import together
from tessera.operators.verify import MATCH, normalized

#: Python's line ends, which are more than \R has.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def name_missing(name: Column, text: Column) -> Column:
    """Whether the name is not in the first two lines that are not blank."""
    lines = F.filter(F.split(text, LINE_END), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))
    return ~F.contains(normalize(F.array_join(F.slice(lines, 1, 2), " ")), normalize(name))


def contacts_missing(basics: Column, text: Column) -> Column:
    """Contacts of a record that the text does not hold, as array<string>."""
    shown = F.concat(F.array(basics["email"], basics["phone"]), F.transform(basics["links"], lambda x: F.coalesce(x["text"], display_url(x["url"]))))
    return F.filter(shown, lambda v: (F.coalesce(v, F.lit("")) != "") & ~F.contains(normalize(text), normalize(v)))


def contacts_absent(text: Column) -> Column:
    """Without a record: which kinds of contact the text has none of."""
    return F.array_compact(F.array(F.when(~text.rlike(EMAIL), "no email address found"), F.when(~text.rlike(PHONE), "no phone number found")))


def odd_headings(headings: Column) -> Column:
    return F.filter(headings, lambda h: ~h.isin(*STANDARD_HEADINGS.values()))


def basic_headings_missing(text: Column) -> Column:
    """Without a record: which of Experience and Education is no line of the text."""
    lines = F.transform(F.split(text, LINE_END), normalize)
    return F.filter(F.array(F.lit("Experience"), F.lit("Education")), lambda h: ~F.array_contains(lines, F.lower(h)))


def stacked_roles(jobs: Column) -> Column:
    """Titles of jobs at the company of the job before."""
    pairs = F.transform(jobs, lambda x, i: F.struct(x["title"].alias("title"), (F.get(jobs, i - 1)["company"] == x["company"]).alias("same")))
    return F.transform(F.filter(pairs, lambda p: F.coalesce(p["same"], F.lit(False))), lambda p: p["title"])


def links_not_clickable(resume: Column, targets: Column) -> Column:
    """URLs of a record that are no targets of the rendering's links."""
    urls = F.concat(F.transform(resume["basics"]["links"], lambda x: x["url"]), F.transform(resume["projects"], lambda x: x["url"]))
    return F.array_except(F.array_compact(urls), targets)


def keyword_coverage(wanted: Column, text: Column) -> Column:
    """struct<found, missing>: technical tokens and proper nouns of one text that another holds."""
    keywords = F.array_distinct(F.concat(tech_tokens(wanted), F.regexp_extract_all(wanted, F.lit(PROPER_NOUN), F.lit(0))))
    hay = normalize(text)
    return F.struct(F.filter(keywords, lambda k: F.contains(hay, F.lower(k))).alias("found"), F.filter(keywords, lambda k: ~F.contains(hay, F.lower(k))).alias("missing"))


def placed(expected: list[str], hay: str) -> list[tuple[int, str]]:
    """(number, missing or misplaced) of items that do not follow each other in the text; a cursor goes over it, verbatim first, then by similarity."""
    at, out = 0, []
    for k, item in enumerate(expected):
        if not item:
            continue
        spot = hay.find(item, at)
        span = (spot, spot + len(item)) if spot >= 0 else best_window(item, hay, MATCH, at)
        if span:
            at = span[1]
        else:
            out.append((k, "misplaced" if item in hay or best_window(item, hay, MATCH) else "missing"))
    return out


def content_order(docs: DataFrame) -> DataFrame:
    """(doc_id, item, problem, text) of items of `docs` (doc_id, expected array<string>, text) that are missing from the text or out of order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, expected, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                expected = [x or "" for x in expected or []]
                rows += [(doc, k, problem, expected[k]) for k, problem in placed([normalized(x) for x in expected], normalized(text or ""))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["doc_id", "item", "problem", "text"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "expected", "text").mapInArrow(run, "doc_id string, item int, problem string, text string")


def checked(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, stage, name, status, location, detail) of all checks for `docs` (doc_id, resume, headings, expected, text)."""
    config = config or Config()
    text, resume = F.col("text"), F.col("resume")
    finding = lambda name, status, details: F.transform(details, lambda d: F.struct(F.lit(name).alias("name"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("location"), d.alias("detail")))
    signs = glyphs(text)
    glyph = F.concat(F.transform(signs["ligatures"], lambda c: F.concat(F.lit("ligature "), c)), F.transform(signs["private_use"], lambda c: F.concat(F.lit("private-use "), c)), F.array_compact(F.array(F.when(signs["replacement"], "replacement character"), F.when(signs["broken_words"], "word broken at a line end"))))
    name = F.array_compact(F.array(F.when(name_missing(resume["basics"]["name"], text), resume["basics"]["name"])))
    stacked = stacked_roles(resume["experience"]) if config.group_roles else F.array().cast("array<string>")
    found = F.concat(finding("Name", "fail", name), finding("Contact", "fail", contacts_missing(resume["basics"], text)), finding("Stacked roles", "warn", stacked), finding("Glyphs", "fail", glyph), finding("Headings", "warn", odd_headings(F.col("headings"))))
    rows = together(docs, found, ["expected", "text"], _order_findings)
    return rows.select("doc_id", F.lit("check").alias("stage"), "name", "status", "location", "detail")


def _order_findings(row: dict) -> Iterator[tuple[str, str, None, str]]:
    expected = [x or "" for x in row["expected"] or []]
    for k, problem in placed([normalized(x) for x in expected], normalized(row["text"] or "")):
        yield "Content and order", "fail", None, f"{problem}: {expected[k]}"
