"""Quality rules as a short-circuit cascade, in DataFrame functions only.

How it scales: everything about a document comes from its own row, so there is no shuffle at all. Within a row the work is linear in the text, but for texts with
repeated runs of words, whose runs are sorted once.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that overlap in a repeated window; base limits of the contract.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
#: Rows of the sample by which rules are ordered (one in SAMPLE_ONE_IN, none longer than SAMPLE_CHARS), and how often it is repeated to be timed.
SAMPLE_ROWS, SAMPLE_ONE_IN, SAMPLE_CHARS, REPEATS = 200, 4, 50_000, 8

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A reason to reject: `fails` is a condition over the columns of `measured`, the text included."""

    name: str
    fails: Column


def default_rules() -> list[Rule]:
    """Rules in the manner of published web-corpus filters. Lines end at \\n alone: (?d) keeps ^ and $ from other line ends."""
    words, lines = F.col("n_words"), F.regexp_count("text", F.lit(r"(?md)^.*" + _WORD + ".*$"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > words),
        Rule("mean_word_length", (F.col("word_chars") < words * 2) | (F.col("word_chars") > words * 15)),
        Rule("duplicate_lines", F.col("n_dup_lines") * 10 > lines * 3),
        Rule("words_without_letters", F.regexp_count("text", F.lit(r"(?<!" + _WORD + r")[^\p{L}\x20\x09-\x0D]++(?!" + _WORD + ")")) * 10 > words * 3),
        Rule("bullet_lines", F.regexp_count("text", F.lit(r"(?md)^[\x20\x09]*[-*•●▪][\x20\x09]")) * 10 > lines * 9),
        Rule("ellipsis_lines", F.regexp_count("text", F.lit(r"(?md)(?:\.\.\.|…)[\x20\x09\x0D]*$")) * 10 > lines * 3),
    ]


def measured(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id and text with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long); with `keep`, the whole row as the struct `kept_row` in place of doc_id.

    A filter on these must name tessera_row too, a number of the row that is not deterministic: else the optimizer moves the filter below and makes the arrays anew
    for each of their elements.
    """
    text = F.coalesce("text", F.lit(""))
    own = ["kept_row" if keep else "doc_id", "text"]
    docs = docs.select(F.struct(*docs.columns).alias("kept_row") if keep else "doc_id", "text", F.expr(r"trim(BOTH ' \t\n\u000b\u000c\r' FROM coalesce(text, ''))").alias("tessera_body"))
    docs = docs.withColumn("tessera_words", F.when(F.col("tessera_body") == "", F.array().cast("array<string>")).otherwise(F.split("tessera_body", _BLANK + "+")))
    docs = docs.withColumn("tessera_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))).withColumn("n_words", F.size("tessera_words").cast("long"))
    run = F.transform("tessera_words", lambda _, i: F.xxhash64(*(F.get("tessera_words", i + k) for k in range(WINDOW))))
    docs = docs.withColumn("tessera_runs", F.when(F.col("n_words") >= WINDOW, F.slice(run, F.lit(1), (F.col("n_words") - WINDOW + 1).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("tessera_sorted", F.when(F.size(F.array_distinct("tessera_runs")) < F.size("tessera_runs"), F.sort_array(F.transform("tessera_runs", lambda x, i: F.struct(x.alias("run"), i.alias("at"))))))
    like = lambda x, i, k: F.coalesce(F.get("tessera_sorted", i + k)["run"] == x["run"], F.lit(False))
    docs = docs.withColumn("tessera_again", F.when(F.col("tessera_sorted").isNotNull(), F.sort_array(F.transform(F.filter("tessera_sorted", lambda x, i: like(x, i, 1) | like(x, i, -1)), lambda x: x["at"]))))
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    cover = F.aggregate("tessera_again", start, lambda a, p: F.struct((a["covered"] + p + WINDOW - F.greatest(p, a["end"])).alias("covered"), (p + WINDOW).alias("end")), lambda a: a["covered"])
    return docs.select(
        *own,
        "n_words",
        F.length(F.array_join("tessera_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("tessera_lines") - F.size(F.array_distinct("tessera_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("tessera_row"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)


def ordered(docs: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """The rules by rejection per cost on a sample of `docs` (doc_id, text): the share of rows that a rule rejects over the time that it takes there.

    Only the order depends on the sample, never a verdict. The sample is the first SAMPLE_ROWS that a hash selects, so few partitions are read; of its rows only
    those that pass the base limits count, as only they reach the cascade.
    """
    docs = docs.select("doc_id", "text")
    found = docs.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE_ONE_IN)) == 0) & (F.length("text") <= SAMPLE_CHARS)).limit(SAMPLE_ROWS).collect()
    sample = measured(docs.sparkSession.createDataFrame(found, docs.schema).repartition(1)).where(~base_failed() & (F.col("tessera_row") >= 0))
    sample = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("repeat")).cache()
    if not sample.count():
        return list(rules)
    tried = []
    for rule in rules:
        rejected = sample.agg(F.avg(F.coalesce(rule.fails, F.lit(False)).cast("double")))
        rejected.first()  # compiles
        began = time.perf_counter()
        share = rejected.first()[0]
        tried.append((share / (time.perf_counter() - began), rule))
    sample.unpersist()
    return [rule for _, rule in sorted(tried, key=lambda x: -x[0])]


def verdict(rules: Sequence[Rule]) -> Column:
    """False at the first rule that fails; later rules are then not evaluated (a CASE has that order)."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(F.coalesce(rule.fails, F.lit(False)), False)
    return out.otherwise(True)


def quality(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of `docs` (doc_id, text; others are not read).

    Words are runs of other than ASCII white space; n_repeat_words counts words in runs of five that occur twice or more in the text, told apart by 64-bit hashes.
    Defined cases: a null or empty text has no words and fails the base limits; a null doc_id stays null; repeated rows each get their own, equal, row; an empty
    table gives no rows.
    """
    rules = ordered(docs, default_rules() if rules is None else rules)
    return measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and any other columns) less the rows that the default rules reject."""
    rules = ordered(docs, default_rules())
    return measured(docs, keep=True).where(verdict(rules) & (F.col("tessera_row") >= 0)).select("kept_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
runs AS (SELECT row, i, ws[i:i + 4] AS run FROM (SELECT row, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, run) AS n FROM runs) WHERE n > 1),
again AS (SELECT row, count(DISTINCT spot) AS n FROM (SELECT row, i + unnest(range(5)) AS spot FROM twice) GROUP BY row),
m AS (SELECT doc_id, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS bare, len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*\x{2022}\x{25cf}\x{25aa}][ \t]'))) AS bullets,
  len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \t\r]*$'))) AS dots FROM w LEFT JOIN again USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 15 OR n_dup_lines * 10 > len(ls) * 3
       OR bare * 10 > n_words * 3 OR bullets * 10 > len(ls) * 9 OR dots * 10 > len(ls) * 3) AS kept
FROM b
"""
