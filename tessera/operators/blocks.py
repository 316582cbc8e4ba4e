"""Operators over blocks; those over arrays stay in a row, those over long tables use windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import normalize, squeezed


def section_of(heading: Column, config: Config) -> Column:
    """The section that a heading stands for, or null: a lookup in a literal map."""
    table = F.create_map(*(F.lit(x) for pair in config.section_of().items() for x in pair))
    return F.try_element_at(table, squeezed(F.lower(F.replace(heading, F.lit("**"), F.lit("")))))


def carried(blocks: DataFrame, column: Column, name: str) -> DataFrame:
    """`name`: the last value of `column` that is not null up to each block of its document."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn(name, F.last(column, ignorenulls=True).over(order))


def split_dropped(blocks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """`dropped`: whether a block is in a section with one of these headings; any heading ends it."""
    heading = F.when(F.col("kind") == "heading", normalize(F.col("text")))
    wanted = [" ".join(n.lower().split()) for n in names]
    return carried(blocks, heading, "under").withColumn("dropped", F.coalesce(F.col("under").isin(*wanted), F.lit(False))).drop("under")


def without_dropped(docs: DataFrame, config: Config) -> DataFrame:
    """Parsed documents with `blocks` less dropped sections and with `dropped`, what went, as `kind: text`. In the row, by a fold."""
    wanted = [" ".join(n.lower().split()) for n in config.drop_sections]
    numbered = F.transform("blocks", lambda b, i: F.struct(b.alias("block"), i.alias("at")))
    starts = F.transform(F.filter(numbered, lambda x: x["block"]["kind"] == "heading"), lambda x: F.struct(x["at"].alias("at"), normalize(x["block"]["text"]).isin(*wanted).alias("drop")))
    inside = lambda i: F.coalesce(F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(False).alias("drop"))), F.filter("tessera_starts", lambda s: s["at"] <= i)), -1)["drop"], F.lit(False))
    docs = docs.withColumn("tessera_starts", starts)
    out = docs.withColumn("dropped", F.transform(F.filter("blocks", lambda b, i: inside(i)), lambda b: F.concat_ws(": ", b["kind"], b["text"])))
    return out.withColumn("blocks", F.filter("blocks", lambda b, i: ~inside(i))).drop("tessera_starts")


def source_headings(blocks: DataFrame, config: Config) -> DataFrame:
    """(doc_id, section, heading): the source's own wording, by the heading's meaning or by the template's section of the first block below; the first wins."""
    known = section_of(F.col("text"), config)
    titled = carried(blocks, F.when(F.col("kind") == "heading", F.struct("seq", F.col("text").alias("heading"), known.alias("known"))), "under")
    below = titled.where((F.col("kind") != "heading") & F.col("section").isNotNull() & F.col("under").isNotNull() & F.col("under.known").isNull())
    first = below.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "under.seq").orderBy("seq"))).where("n = 1")
    named = titled.where((F.col("kind") == "heading") & known.isNotNull()).select("doc_id", "seq", known.alias("section"), F.col("text").alias("heading"))
    every = named.unionByName(first.select("doc_id", "seq", "section", F.col("under.heading").alias("heading")))
    return every.groupBy("doc_id", "section").agg(F.min_by("heading", "seq").alias("heading"))


def raw_text(blocks: Column) -> Column:
    """All texts of an array of blocks, one a line."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def islands(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """`island`: the number of the run of equal `value`s that a row is in."""
    window = Window.partitionBy(*key).orderBy(*order)
    starts = F.when(F.lag(value).over(window).eqNullSafe(F.col(value)) & (F.row_number().over(window) > 1), 0).otherwise(1)
    return rows.withColumn("tessera_start", starts).withColumn("island", F.sum("tessera_start").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("tessera_start")
