"""Indel similarity: 200 * LCS / (both lengths), by bit-parallel rows; batches come by Arrow, built-in levenshtein is another measure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is one integer, a bit for each character of a."""
    seen: dict[str, int] = {}
    for k, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & seen.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def at_least(a: str, b: str, percent: int) -> bool:
    """Whether the similarity is at least so many percent; exact in integers, and the lengths are looked at first, as LCS is at most the shorter."""
    total = len(a) + len(b)
    return total == 0 or 200 * min(len(a), len(b)) >= percent * total and (a == b or 200 * lcs(a, b) >= percent * total)


def similarity(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b) / total


def best_window(needle: str, hay: str, percent: int, start: int = 0) -> tuple[int, int] | None:
    """(from, to) of the stretch of hay[start:] most like `needle`, no longer than it, if that is at least so similar.

    Stretches that begin and end with characters of the needle are enough, as others gain nothing by their ends.
    """
    n, best, found = len(needle), -1.0, None
    if not n or start >= len(hay):
        return None
    if len(hay) - start < n:
        score = similarity(needle, hay[start:])
        return (start, len(hay)) if score >= percent else None
    inside = set(needle)
    edges = [(k, k + n) for k in range(start, len(hay) - n + 1) if hay[k + n - 1] in inside or hay[k] in inside]
    edges += [(start, start + k) for k in range(1, n) if hay[start + k - 1] in inside] + [(len(hay) - k, len(hay)) for k in range(1, n) if hay[len(hay) - k] in inside]
    for a, b in edges:
        if 200 * min(n, b - a) >= percent * (n + b - a) and (score := similarity(needle, hay[a:b])) > best:
            best, found = score, (a, b)
    return found if best >= percent else None


def length_band(a: Column, b: Column, percent: int) -> Column:
    """What lengths allow: a join condition that is exact, cheap and in generated code."""
    return F.least(F.length(a), F.length(b)) * 200 >= (F.length(a) + F.length(b)) * percent


@F.pandas_udf(T.DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity of two texts, 0 to 100; null if either is."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def is_similar(a: Column, b: Column, percent: int) -> Column:
    """Whether two texts are at least so similar; equal ones need no Python."""
    return F.when(a == b, True).when(~length_band(a, b, percent), False).otherwise(F.round(ratio(a, b) * 1000) >= percent * 1000)
