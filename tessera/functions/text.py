"""Text functions over columns; all built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that count as one.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
QUOTES = "\u2018\u2019\u201a\u2032"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u2033"
BULLETS = "\u2022\u00b7\u25aa\u25e6\u2023\u25cf\u2219"
_FROM = DASHES + QUOTES + DOUBLE_QUOTES + BULLETS + "\u00a0"
_TO = "-" * len(DASHES) + "'" * len(QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * (len(BULLETS) + 1)
#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"

# Patterns of tokens.
WORDLIKE = r"[A-Za-z0-9][A-Za-z0-9.+#/&-]*"
NUMBER = r"(?U)[₹$€£]?\d+(?:[.,]\d+)*(?:%|\+|[xkKML]\b)?"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(\.[\w-]+)+"
PHONE = r"(?U)\+?\d[\d\s().-]{8,16}\d"
PROPER_NOUN = r"(?<=[a-z,;:] )[A-Z][a-z]{2,}\b"
FIRST_PERSON = r"\b(I|[Mm]y|[Mm]e)\b"
ITEM_GAP = r",\s*(?![^()]*\))"
TAG = r"</?[A-Za-z][^<>]*>"
COMMAND = r"\\[A-Za-z]+\{"

# Words of the style rules.
WEAK_STARTS = ("responsible for", "worked on", "helped", "assisted")
PRESENT_VERBS = ("build", "design", "develop", "lead", "manage", "create", "maintain", "write", "own", "drive", "support", "work", "implement", "run", "deliver", "automate", "optimize")
NOT_VERBS = ("across", "analysis", "business", "process", "status", "this", "its", "always")


def squeezed(text: Column) -> Column:
    """White space at the ends gone, and runs of it one space."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize(text: Column) -> Column:
    """Lower case; one sign for each kind of dash, quote and bullet; no bold marks; single spaces."""
    return squeezed(F.lower(F.translate(F.replace(text, F.lit("**"), F.lit("")), _FROM, _TO)))


def tech_tokens(text: Column) -> Column:
    """Different tokens that look technical, in order of first appearance: mixed or all capitals, digits with letters, or an inner . + # /."""
    found = F.regexp_extract_all(F.replace(text, F.lit("**"), F.lit("")), F.lit(WORDLIKE), F.lit(0))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"[.\-/&]+$", ""))
    capitals = lambda t: (F.length(t) > 1) & t.rlike("[A-Z]") & ~t.rlike("[a-z]")
    techy = lambda t: t.rlike("[a-z][A-Z]") | capitals(t) | (t.rlike("[0-9]") & t.rlike("[A-Za-z]")) | t.rlike(r"[A-Za-z0-9_][.+#/]")
    return F.array_distinct(F.filter(bare, techy))


def numbers(text: Column) -> Column:
    """All numeric tokens, with currency signs, separators and units."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def display_url(url: Column) -> Column:
    """Without its scheme and final slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), "/+$", "")


def items(text: Column) -> Column:
    """Parts between commas that are not inside parentheses."""
    return F.filter(F.transform(F.split(text, ITEM_GAP), lambda x: F.trim(x)), lambda x: x != "")


def segments(text: Column) -> Column:
    """Stretches between bold marks: every second one is bold, empty ones go."""
    parts = F.transform(F.split(text, r"\*\*"), lambda x, i: F.struct(x.alias("text"), (i % 2 == 1).alias("bold")))
    return F.filter(parts, lambda x: x["text"] != "")


def is_email(text: Column) -> Column:
    return text.rlike(rf"\A(?:{EMAIL})\z")


def is_phone(text: Column) -> Column:
    return text.rlike(rf"\A(?:{PHONE})\z")


def first_person(text: Column) -> Column:
    """The first pronoun of the first person, or an empty string."""
    return F.regexp_extract(text, FIRST_PERSON, 1)


def weak_start(text: Column) -> Column:
    low = F.lower(text)
    out = low.startswith(WEAK_STARTS[0])
    for phrase in WEAK_STARTS[1:]:
        out = out | low.startswith(phrase)
    return out


def first_word(text: Column) -> Column:
    return F.split(squeezed(text), " ")[0]


def present_tense(text: Column) -> Column:
    """Whether the first word has the shape of a verb in the present: listed, in -ing, or with a plural s."""
    word = F.regexp_replace(F.lower(first_word(F.replace(text, F.lit("**"), F.lit("")))), r"^[,.:;]+|[,.:;]+$", "")
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$")
    return ~word.isin(*NOT_VERBS) & (word.isin(*PRESENT_VERBS) | word.endswith("ing") | plural)


def markup_problem(text: Column) -> Column:
    """What is not allowed in a text: an odd number of bold marks, a tag or a command; null if nothing."""
    odd = (F.size(F.split(text, r"\*\*")) - 1) % 2 == 1
    tag, command = F.regexp_extract(text, TAG, 0), F.regexp_extract(text, COMMAND, 0)
    return F.when(odd, F.lit("unbalanced **")).when(tag != "", tag).when(command != "", command)


def short_tags(texts: Column, most: int = 40) -> Column:
    """Whether a list is tags for one line rather than sentences."""
    return (F.size(texts) > 1) & F.forall(texts, lambda x: (F.length(x) <= most) & ~x.contains("**") & ~x.endswith("."))


def glyphs(text: Column) -> Column:
    """Signs that an extraction went wrong: ligatures, replacement characters, private-use characters, words broken at a line end."""
    distinct = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    return F.struct(
        distinct("[\ufb00-\ufb06]").alias("ligatures"),
        text.contains("\ufffd").alias("replacement"),
        distinct(r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}]").alias("private_use"),
        text.rlike(r"(?U)[A-Za-z]-\n\s*[a-z]").alias("broken_words"),
    )
