"""Benchmark decontamination by greedy string tiling.

How it scales: the benchmark's seeds (hashes of SEED words in a row) travel to every task in blocks of a bounded size, one pass over the documents for each block; a
text meets them by a table of bits first. Only documents that share a seed are tiled, each in its own task, so nothing is shuffled and one common passage costs no
more than the documents that hold it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import LOWER, slices, span_hashes, spans, windows

#: Words of a seed, which is also the shortest tile (all words of a shorter item), and the share of a passage's words that tiles must cover.
SEED, COVERAGE = 5, 0.7
#: Words of the benchmark that are handled in one pass (16 bytes each on every worker).
BLOCK_WORDS = 2_000_000
_BITS = 22
#: Pairs of equal runs looked at together.
PAIRS = 1 << 20


def _runs(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of the runs of `length` places that are all free."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[length:] == taken[:-length])


def matches(text: np.ndarray, passage: np.ndarray, free_t: np.ndarray, free_p: np.ndarray, sought: int) -> Iterator[tuple[int, int, int]]:
    """(length, start in the passage, start in the text) of the matches of `sought` free words or more that can be made longer at neither end.

    The hashes of the passage's runs are a sorted table in which those of the text are looked up. A pair that its predecessors on both sides extend is no start,
    so text and passage of one repeated word have as many matches as words, not as pairs of them. Pairs are looked at PAIRS at a time.
    """
    if min(len(text), len(passage)) < sought:
        return
    j = _runs(free_p, sought)
    runs = windows(passage, sought)[j]
    order = np.argsort(runs, kind="stable")
    j, runs = j[order], runs[order]
    i = _runs(free_t, sought)
    wanted = windows(text, sought)[i]
    low = np.searchsorted(runs, wanted, "left")
    n = np.searchsorted(runs, wanted, "right") - low
    i, low, n = i[n > 0], low[n > 0], n[n > 0]
    done = np.cumsum(n)
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(done // PAIRS)) + 1) if len(i) else ():
        at = np.repeat(i[part], n[part])
        to = j[np.repeat(low[part] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(len(at))]
        before = (at > 0) & (to > 0)
        before[before] = (text[at[before] - 1] == passage[to[before] - 1]) & free_t[at[before] - 1] & free_p[to[before] - 1]
        at, to = at[~before], to[~before]
        length, live = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(live):
            x, y = at[live] + length[live], to[live] + length[live]
            live, x, y = (k[(x < len(text)) & (y < len(passage))] for k in (live, x, y))
            live = live[(text[x] == passage[y]) & free_t[x] & free_p[y]]
            length[live] += 1
        long = length >= sought
        yield from zip(length[long].tolist(), to[long].tolist(), at[long].tolist(), strict=True)


def tiles(text: np.ndarray, passage: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in the text, start in the passage, length), none shorter than `least`, none overlapping.

    Running Karp-Rabin: all matches of a length or more are found by hashes of runs of that length, and the longest are marked first; of equals, the first in the
    passage, then in the text. A match that tiles have cut goes back in line with each free rest of that length or more. Then the length is halved, down to `least`;
    matches over twice as long as the first length are simply longer ones of that pass.
    """
    free_t, free_p = np.ones(len(text), bool), np.ones(len(passage), bool)
    out, sought = [], max(least, min(len(passage), len(text), 4 * least))
    while True:
        line = [(-n, j, i) for n, j, i in matches(text, passage, free_t, free_p, sought)]
        heapify(line)
        while line:
            n, j, i = heappop(line)
            free = free_t[i : i - n] & free_p[j : j - n]
            if free.all():
                free_t[i : i - n] = free_p[j : j - n] = False
                out.append((i, j, -n))
                if not len(_runs(free_p, sought)):
                    break
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= sought:
                    heappush(line, (a - b, j + a, i + a))
        if sought == least:
            return sorted(out)
        sought = max(least, sought // 2)


class Passages:
    """Word hashes of benchmark items, and the items that hold each seed."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.words = ids, []
        for _, _, data, offsets in slices(pa.array(texts, pa.string())):
            starts, ends, firsts = spans(data, offsets)
            words = span_hashes(LOWER[data], starts, ends)
            self.words += [words[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        self.seeds = {}
        for width in sorted({min(SEED, len(w)) for w in self.words} - {0}):
            own = [k for k, w in enumerate(self.words) if min(SEED, len(w)) == width]
            seeds = [windows(self.words[k], width) for k in own]
            every, owner = np.concatenate(seeds), np.repeat(own, [len(x) for x in seeds])
            order = np.argsort(every, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[every >> np.uint64(64 - _BITS)] = True
            self.seeds[width] = every[order], owner[order], bits

    def sharing(self, runs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) for each of the runs of `width` words that is a seed of the item."""
        seeds, owner, bits = self.seeds[width]
        maybe = np.flatnonzero(bits[runs >> np.uint64(64 - _BITS)])
        low, high = np.searchsorted(seeds, runs[maybe], "left"), np.searchsorted(seeds, runs[maybe], "right")
        n = high - low
        return np.repeat(maybe, n), owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def _matched(docs: DataFrame, passages: Passages, coverage: float, item_type: str) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = known.value
        for batch in batches:
            rows, items, words, covered, count = [], [], [], [], []
            for a, _, data, offsets in slices(batch.column(1)):
                starts, ends, firsts = spans(data, offsets)
                hashes = span_hashes(LOWER[data], starts, ends)
                pairs = []
                for width in p.seeds:
                    place, item = p.sharing(windows(hashes, width), width)
                    row = np.searchsorted(firsts, place, "right") - 1
                    inside = place + width <= firsts[row + 1]
                    pairs += np.unique(np.stack([row[inside], item[inside]], axis=1), axis=0).tolist()
                for r, k in pairs:
                    found = tiles(hashes[firsts[r] : firsts[r + 1]], p.words[k], min(SEED, len(p.words[k])))
                    n = sum(m for _, _, m in found)
                    if n >= coverage * len(p.words[k]):
                        rows.append(a + r)
                        items.append(p.ids[k])
                        words.append(len(p.words[k]))
                        covered.append(n)
                        count.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, out_type), pa.array(words, pa.int64()), pa.array(covered, pa.int64()), pa.array(count, pa.int64())], ["doc_id", "item_id", "item_words", "covered_words", "n_tiles"])

    out_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, item_words long, covered_words long, n_tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, coverage) for each row of `docs` (doc_id, text) and item of `benchmark` (item_id, text) that it leaks.

    Words are runs of other than ASCII white space, A-Z in lower case. An item leaks if tiles of SEED words or more (all its words, if it has fewer) cover at least `coverage` of its words, in any
    order. Defined cases: null and empty texts share nothing; an item without words is never found; null ids stay null; repeated
    rows give repeated results; ties between tiles go to the first; empty tables give no rows; other columns, whatever their names, are not read.
    """
    docs, items = docs.select("doc_id", "text"), benchmark.select("item_id", "text").where("text is not null")
    kind = items.schema["item_id"].dataType.simpleString()
    kind, items = (kind, items) if kind in ("bigint", "int", "string") else ("string", items.withColumn("item_id", F.col("item_id").cast("string")))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 2 / BLOCK_WORDS))  # a word has a character and a space at least
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        rows = sorted(rows, key=lambda r: (r.item_id is not None, r.item_id, r.text))
        found = _matched(docs, Passages([r.item_id for r in rows], [r.text for r in rows]), coverage, kind)
        out = found if out is None else out.union(found)
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))
