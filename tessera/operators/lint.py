"""Style warnings over records; all but near duplicates are array functions in the row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import month_index
from tessera.functions.similarity import at_least
from tessera.functions.text import first_person, first_word, normalize, present_tense, squeezed, tech_tokens, weak_start
from tessera.operators.findings import together

# Limits.
BULLET, SUMMARY, SKILLS, REPEATS, DUPLICATE = 220, 420, 35, 3, 90


def bullets(resume: Column) -> Column:
    """array<struct<location, text, past>> of the bullets of jobs and projects; past: its job has ended."""
    one = lambda name, ended: F.flatten(F.transform(resume[name], lambda x, i: F.transform(x["bullets"], lambda t, j: F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("].bullets["), j.cast("string"), F.lit("]")).alias("location"), t.alias("text"), ended(x).alias("past")))))
    return F.concat(one("experience", lambda x: F.coalesce(x["end"] != "present", F.lit(False))), one("projects", lambda x: F.lit(False)))


def overlapping(jobs: Column) -> Column:
    """array<struct<first, second>> of pairs of jobs whose half-open ranges meet."""
    ranged = F.transform(jobs, lambda x, i: F.struct(i.alias("at"), month_index(x["start"]).alias("a"), month_index(x["end"]).alias("b")))
    full = F.filter(ranged, lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    return F.flatten(F.transform(full, lambda x: F.transform(F.filter(full, lambda y: (x["at"] < y["at"]) & (x["a"] < y["b"]) & (y["a"] < x["b"])), lambda y: F.struct(x["at"].alias("first"), y["at"].alias("second")))))


def _warning(rule: str, location: Column, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("name"), location.alias("location"), message.alias("detail"))


def row_warnings(resume: Column, listed: str = "bullets") -> Column:
    """array<struct<name, location, detail>> of all rules that need no similarity; `listed` names a column with `bullets(resume)`."""
    each = lambda rule, test, message: F.transform(F.filter(listed, test), lambda b: _warning(rule, b["location"], message(b["text"])))
    summary = resume["summary"]
    whole = lambda rule, test, location, message: F.when(F.coalesce(test, F.lit(False)), F.array(_warning(rule, F.lit(location), message))).otherwise(F.array().cast("array<struct<name:string,location:string,detail:string>>"))
    tokens = F.flatten(F.transform(listed, lambda b: F.transform(tech_tokens(b["text"]), F.lower)))
    counted = F.transform(F.array_sort(F.array_distinct(tokens)), lambda t: F.struct(t.alias("token"), F.size(F.filter(tokens, lambda x: x == t)).alias("n")))
    repeats = F.transform(F.filter(counted, lambda x: x["n"] > REPEATS), lambda x: _warning("keyword-repeat", F.lit("bullets"), F.concat(x["token"], F.lit(" is in "), x["n"].cast("string"), F.lit(" bullets"))))
    total = F.aggregate(resume["skills"], F.lit(0), lambda a, s: a + F.size(s["items"]))
    gap = lambda name, test: F.transform(F.filter(F.transform(resume[name], lambda x, i: F.struct(i.alias("at"), test(x).alias("gap"))), lambda x: x["gap"]), lambda x: _warning("missing-date", F.concat(F.lit(f"{name}["), x["at"].cast("string"), F.lit("]")), F.lit("a date is missing")))
    written = F.filter(F.flatten(F.transform(resume["experience"], lambda x: F.array(x["start"], x["end"]))), lambda d: d.isNotNull() & (d != "present"))
    mixed = F.size(F.array_distinct(F.transform(written, lambda d: d.contains("-")))) > 1
    overlaps = F.transform(overlapping(resume["experience"]), lambda p: _warning("overlapping-dates", F.concat(F.lit("experience["), p["first"].cast("string"), F.lit("] and experience["), p["second"].cast("string"), F.lit("]")), F.lit("date ranges overlap")))
    return F.concat(
        each("long-bullet", lambda b: F.length(b["text"]) > BULLET, lambda t: F.concat(F.length(t).cast("string"), F.lit(" characters"))),
        each("weak-start", lambda b: weak_start(b["text"]), lambda t: F.concat(F.lit("starts with "), F.array_join(F.slice(F.split(squeezed(t), " "), 1, 2), " "))),
        each("first-person", lambda b: first_person(b["text"]) != "", lambda t: F.concat(F.lit("first-person pronoun "), first_person(t))),
        each("tense", lambda b: b["past"] & present_tense(b["text"]), lambda t: F.concat(F.lit("present tense in a past role: "), first_word(t))),
        whole("first-person", first_person(summary) != "", "summary", F.concat(F.lit("first-person pronoun "), first_person(summary))),
        whole("long-summary", F.length(summary) > SUMMARY, "summary", F.concat(F.length(summary).cast("string"), F.lit(" characters"))),
        repeats,
        whole("many-skills", total > SKILLS, "skills", F.concat(total.cast("string"), F.lit(" skill items"))),
        gap("experience", lambda x: x["start"].isNull() | x["end"].isNull()),
        gap("education", lambda x: x["end"].isNull()),
        whole("mixed-dates", mixed, "experience", F.lit("mixes YYYY-MM and YYYY dates")),
        overlaps,
    )


def alike(bullets: list[dict]) -> Iterator[tuple[str, str, str, str]]:
    """Pairs of alike texts among normalized `bullets` (location, text): sorted by length, a text meets only those of lengths that allow it."""
    texts = sorted((len(b["text"]), k) for k, b in enumerate(bullets))
    pairs = []
    for x, (size, k) in enumerate(texts):
        for longer, j in texts[x + 1 :]:
            if 200 * size < DUPLICATE * (size + longer):
                break
            if at_least(bullets[k]["text"], bullets[j]["text"], DUPLICATE):
                pairs.append(tuple(sorted((k, j))))
    for k, j in sorted(pairs):
        yield "duplicate-bullet", "warn", f"{bullets[k]['location']} and {bullets[j]['location']}", "near-duplicate"


def _normalized(bullets: Column) -> Column:
    return F.transform(bullets, lambda b: F.struct(b["location"].alias("location"), normalize(b["text"]).alias("text")))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, name, location, detail) of pairs of alike texts in `docs` (doc_id, bullets)."""
    plain = docs.select("doc_id", _normalized(F.col("bullets")).alias("bullets"))
    return together(plain, F.lit(None), ["bullets"], lambda row: alike(row["bullets"])).drop("status")


def linted(docs: DataFrame) -> DataFrame:
    """(doc_id, stage, name, status, location, detail) of the warnings for `docs` (doc_id, resume)."""
    docs = docs.select("doc_id", "resume", bullets(F.col("resume")).alias("bullets"))
    warned = F.transform(row_warnings(F.col("resume")), lambda w: F.struct(w["name"].alias("name"), F.lit("warn").alias("status"), w["location"].alias("location"), w["detail"].alias("detail")))
    found = together(docs.select("doc_id", warned.alias("warned"), _normalized(F.col("bullets")).alias("bullets")), F.col("warned"), ["bullets"], lambda row: alike(row["bullets"]))
    return found.select("doc_id", F.lit("lint").alias("stage"), "name", "status", "location", "detail")
