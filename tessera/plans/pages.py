"""Checks and a fitting search over measures of pages, wherever those come from: no PDF library is needed here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paper sizes in points, and the search's limits.
SIZES = {"a4": (595.28, 841.89), "us-letter": (612.0, 792.0)}
TRIES, THIN_PAGE = 8, 0.15


def hygiene(pages: DataFrame, paper: str = "a4", most_pages: int = 2, most_mb: float = 2.0) -> DataFrame:
    """(doc_id, detail) of what is wrong with `pages` (doc_id, page, width, height, text, fonts array<struct<name, embedded>>, file_bytes)."""
    width, height = SIZES[paper]
    page = F.concat(F.lit("page "), F.col("page").cast("string"))
    size = (F.abs(F.col("width") - width) > 1) | (F.abs(F.col("height") - height) > 1)
    fonts = F.transform(F.filter("fonts", lambda f: ~f["embedded"]), lambda f: F.concat(page, F.lit(": font "), f["name"], F.lit(" is not embedded")))
    own = F.concat(F.array_compact(F.array(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.concat(page, F.lit(" has no text"))), F.when(size, F.concat(page, F.lit(f" is not {paper}"))))), fonts)
    each = pages.select("doc_id", F.explode(own).alias("detail"))
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("n"), (F.max("file_bytes") / 1e6).alias("mb"))
    over = F.array_compact(F.array(F.when(F.col("n") > most_pages, F.concat(F.col("n").cast("string"), F.lit(f" pages, limit is {most_pages}"))), F.when(F.col("mb") > most_mb, F.concat(F.format_number("mb", 2), F.lit(f" MB, limit is {most_mb}")))))
    return each.unionByName(whole.select("doc_id", F.explode(over).alias("detail")))


def overflow(words: DataFrame, limit: int) -> DataFrame:
    """(doc_id, pages, beyond, fill) of `words` (doc_id, page, line, bottom, top_margin, bottom_margin, height): lines beyond the limit and how full the last page is."""
    by_page = words.groupBy("doc_id", "page").agg(F.countDistinct("line").alias("lines"), F.max("bottom").alias("bottom"), F.first("height").alias("height"), F.first("top_margin").alias("top"), F.first("bottom_margin").alias("foot"))
    last = F.max_by(F.struct("bottom", "height", "top", "foot"), "page")
    out = by_page.groupBy("doc_id").agg(F.max("page").alias("pages"), F.sum(F.when(F.col("page") > limit, F.col("lines")).otherwise(0)).alias("beyond"), last.alias("last"))
    fill = (F.col("last.bottom") - F.col("last.top")) / (F.col("last.height") - F.col("last.top") - F.col("last.foot"))
    return out.select("doc_id", "pages", "beyond", F.greatest(F.lit(0.0), F.least(F.lit(1.0), fill)).alias("fill"))


def longest(parts: Column, most: int = 3) -> Column:
    """struct<sections, bullets> of the sections with most characters and the longest bullets of a rendering's `sections`; equals keep their order."""
    size = lambda b: F.aggregate(F.concat(b["left"], b["right"], b["texts"], b["bullets"]), F.lit(0), lambda a, t: a + F.length(F.coalesce(t, F.lit(""))))
    sized = F.transform(parts, lambda s, i: F.struct((-F.aggregate(s["blocks"], F.lit(0), lambda a, b: a + size(b))).alias("n"), i.alias("at"), s["heading"].alias("text")))
    bullets = F.flatten(F.transform(parts, lambda s: F.flatten(F.transform(s["blocks"], lambda b: F.concat(b["bullets"], F.when(b["kind"] == "bullets", b["texts"]).otherwise(F.array().cast("array<string>")))))))
    long = F.transform(bullets, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("at"), t.alias("text")))
    top = lambda rows: F.transform(F.slice(F.array_sort(rows), 1, most), lambda r: F.struct(r["text"].alias("text"), (-r["n"]).alias("characters")))
    return F.struct(top(sized).alias("sections"), top(long).alias("bullets"))


@dataclass(frozen=True)
class Fit:
    settings: dict[str, float]
    pages: int
    fits: bool
    tries: int
    warning: str | None = None


def steps(settings: dict[str, float], floors: dict[str, float], factors: tuple[float, ...] = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65)) -> Iterator[dict[str, float]]:
    """Tighter and tighter settings, none below its floor."""
    for factor in factors[: TRIES - 1]:
        yield {k: max(v * factor, floors.get(k, 0.0)) for k, v in settings.items()}


def fit(settings: dict[str, float], floors: dict[str, float], measure: Callable[[dict[str, float]], tuple[int, float]], limit: int) -> Fit:
    """The first of at most TRIES settings whose (pages, fill of the last page) keeps the limit; if none does, the settings as they were. Nothing is ever left out."""
    tries, first = 0, None
    for now in (settings, *steps(settings, floors)):
        pages, fill = measure(now)
        tries += 1
        first = first or pages
        if pages <= limit:
            thin = pages > 1 and fill < THIN_PAGE
            return Fit(now, pages, True, tries, f"the last page is {fill:.0%} full" if thin else None)
    return Fit(settings, first, False, tries)
