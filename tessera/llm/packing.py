"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search.

How it scales: tokens are made in one narrow pass that keeps a 40-byte record of each piece. Full pieces are sequences by themselves; the others are dealt evenly
into shards of bounded size, whatever their ids, and each shard is packed on its own. A shard wastes less than a sequence or so, which is far below a thousandth.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import saved
from tessera.llm.textbytes import SPACE, representatives, slices, span_hashes

#: Tokens of a sequence and the id that ends a document.
CAPACITY, END_ID = 1024, 2
#: Pieces packed together.
SHARD = 20_000
#: Bytes tokenized at once and different words kept with their ids (then the store starts anew).
SLICE_BYTES, MAX_WORDS = 2 << 20, 1_200_000
SPECIAL = b"<|endoftext|>"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of stretches that a byte-level BPE encodes independently: letters with the one white-space byte before them, or signs that follow letters.

    Its pre-tokenizer ends a run of letters at whatever else follows. It always breaks before the last white-space character in front of another character. Next to bytes beyond ASCII, which may be white space
    too, a stretch starts only where the white space is that one byte after an ASCII character.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space, ascii_ = SPACE[data], data < 128
    word = ~space & ascii_
    cut = np.zeros(n, bool)
    cut[:-1] = space[:-1] & word[1:]
    cut[1:-1] |= space[1:-1] & ~ascii_[2:] & word[:-2]
    letter = LETTER[data]
    cut[1:] |= letter[:-1] & word[1:] & ~letter[1:]
    cut[offsets[offsets > 0] - 1] &= ~space[offsets[offsets > 0] - 1]
    cut[offsets[offsets < n]] = True
    return np.flatnonzero(cut)


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for `size` values at least; room doubles, so that copies stay rare."""
    if size <= len(array):
        return array
    out = np.empty(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Encoder:
    """Token ids of whole texts; each different stretch is encoded once and its ids are kept by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes, and the place of each in the store
        self.pool, self.filled = np.array([END_ID], np.uint32), 1
        self.start, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)  # place 0: the end of a document

    def learn(self, texts: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.known) + 1
        self.start, self.length = (_grown(x, first + len(ids)) for x in (self.start, self.length))
        self.pool = _grown(self.pool, self.filled + int(lengths.sum()))
        self.start[first : first + len(ids)] = self.filled + np.cumsum(lengths) - lengths
        self.length[first : first + len(ids)] = lengths
        self.pool[self.filled : self.filled + int(lengths.sum())] = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self.filled += int(lengths.sum())

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place of each stretch in the store, learning new ones."""
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        first, which = representatives(hashes)
        if len(self.known) + len(first) > MAX_WORDS:
            self.forget()
        order = np.argsort(hashes[first])
        first, distinct = first[order], hashes[first[order]]
        spot = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(np.searchsorted(self.known, distinct, "right") == spot)
        if len(new):
            raw = data.tobytes()
            self.learn([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.where = np.insert(self.where, spot[new], len(self.known) + 1 + np.arange(len(new)))
            self.known = np.insert(self.known, spot[new], distinct[new])
            spot = np.searchsorted(self.known, distinct)
        place = np.empty(len(first), np.int64)
        place[order] = self.where[spot]
        return place[which]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by END_ID; where each text's ids begin, and their end)."""
        if SPECIAL in data.tobytes():
            return self.plainly(data, offsets)
        starts = units(data, offsets)
        place = np.insert(self.places(data, starts), np.searchsorted(starts, offsets[1:]), 0)
        lengths = self.length[place]
        done = np.cumsum(lengths)
        ids = self.pool[np.arange(int(done[-1])) + np.repeat(self.start[place] - done + lengths, lengths)]
        return ids, np.insert(done[np.flatnonzero(place == 0)], 0, 0)

    def plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, text by text: where the string of a special token may change what lies beside it."""
        raw = data.tobytes()
        found = [np.array([*self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, END_ID], np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, place) of each piece; place is a different number for each, dealt without regard to ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.setdefault(tokenizer, None) or Encoder(tokenizer)
        _encoders[tokenizer] = encode
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), SLICE_BYTES):
                ids, bounds = encode(data, offsets)
                total = np.diff(bounds)
                count = -(-total // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = (total - capacity * (count - 1))[row]
                start = np.where(piece > 0, short + capacity * (piece - 1), 0)
                length = np.where(piece > 0, capacity, short)
                at = bounds[row] + start
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[x : x + n]) for x, n in zip(at, length, strict=True)]
                out = [batch.column(0).take(pa.array(row + a)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(place + np.arange(len(row)))]
                place += len(row)
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, place long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            where = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[where].append(item)
        else:
            free, where = capacity, len(bins)
            bins.append([item])
        if left := free - size:
            room[left].append(where)
            mask |= 1 << left
    return bins


class Search:
    """Local search over underfull bins.

    The emptiest bin gives tokens away: a move, an exchange of one item for a shorter one, of two for one or of one for two, always the one that moves most
    and fits; each step raises the sum of squared fills. A bin that becomes empty goes. For each sum of one or two items, the search keeps how many bins have it
    and at least so much room, so that the best step is found without looking at the bins.
    """

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.bins = bins
        self.free = [capacity - sum(self.sizes[i] for i in b) for b in bins]
        self.one = np.zeros((capacity + 1, capacity + 2), np.int32)  # [sum, room]: bins with such an item (sum 0: any bin)
        self.two = np.zeros((capacity + 1, capacity + 2), np.int32)
        self.having: dict[tuple[int, int], dict[int, int]] = {}
        for b, free in enumerate(self.free):
            if free:
                self.index(b, 1)

    def sums(self, b: int) -> list[tuple[int, int]]:
        own = [self.sizes[i] for i in self.bins[b]]
        return [(1, 0), *((1, x) for x in own), *((2, x + y) for k, x in enumerate(own) for y in own[:k])]

    def index(self, b: int, sign: int) -> None:
        for kind, total in self.sums(b):
            (self.one if kind == 1 else self.two)[total, : self.free[b] + 1] += sign
            held = self.having.setdefault((kind, total), {})
            held[b] = held.get(b, 0) + sign
            if not held[b]:
                del held[b]

    def step(self, b: int) -> bool:
        """Move tokens from bin b, which is not in the index, to the bin where most can go."""
        own, best = [self.sizes[i] for i in self.bins[b]], (0,)
        gives = [((k,), x) for k, x in enumerate(own)] + [((j, k), own[j] + own[k]) for k in range(len(own)) for j in range(k)]
        for which, x in gives:
            for kind in (1, 2) if len(which) == 1 else (1,):
                takes = np.arange(x)
                fits = np.flatnonzero((self.one if kind == 1 else self.two)[takes, x - takes])
                if len(fits) and x - fits[0] > best[0]:
                    best = (x - int(fits[0]), which, kind, int(fits[0]))
        if not best[0]:
            return False
        moved, which, kind, total = best
        to = min((c for c in self.having[kind, total] if self.free[c] >= moved), key=lambda c: (self.free[c], c))
        self.index(to, -1)
        back: list[int] = []
        if total:
            there = self.bins[to]
            spots = [(k,) for k in range(len(there))] if kind == 1 else [(j, k) for k in range(len(there)) for j in range(k)]
            spot = next(s for s in spots if sum(self.sizes[there[k]] for k in s) == total)
            back = [there[k] for k in spot]
        given = [self.bins[b][k] for k in which]
        self.bins[to] = [i for i in self.bins[to] if i not in back] + given
        self.bins[b] = [i for i in self.bins[b] if i not in given] + back
        self.free[to] -= moved
        self.free[b] += moved
        if self.free[to]:
            self.index(to, 1)
        return True

    def run(self) -> list[list[int]]:
        """The bins after passes over all underfull ones, the emptiest first, until a whole pass empties none or there are no more bins than the tokens fill.

        A bin that cannot be emptied takes no part in the rest of a pass, so tokens go to fuller bins alone and each step raises the squared fill.
        """
        least = -(-sum(self.sizes) // self.capacity)
        count = len(self.bins)
        emptied = True
        while emptied and count > least:
            emptied, stuck = False, []
            for b in sorted((b for b, free in enumerate(self.free) if free and self.bins[b]), key=lambda b: (-self.free[b], b)):
                if self.free[b]:
                    self.index(b, -1)
                    while self.bins[b] and self.step(b):
                        pass
                    if self.bins[b]:
                        stuck.append(b)
                    else:
                        count, emptied = count - 1, True
                        if count == least:
                            break
            for b in stuck:
                self.index(b, 1)
        return [b for b in self.bins if b]


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers, none longer than capacity."""
    return Search(sizes, best_fit(sizes, capacity), capacity).run()


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each document's ids, END_ID last, packed into sequences of at most `capacity` tokens.

    Only a document of more ids is cut, into pieces of `capacity`, the first of which may be shorter. Other columns, whatever their names, are not read.
    Defined cases: a null or empty text is the one id END_ID; a null doc_id and repeated rows are packed as rows of their own; an empty table gives no rows;
    of equal sizes any goes first, the same in every run.
    """
    found = saved(pieces(docs.select("doc_id", "text"), tokenizer, capacity), "pieces")
    part = found.where(F.col("length") < capacity)
    shards = max(1, math.ceil(part.count() / SHARD))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", ignore_index=True)
        sequence, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
        sizes = frame["length"].to_numpy()
        for number, items in enumerate(pack(sizes, capacity)):
            sequence[items] = -1 - number - (int(frame["shard"].iloc[0]) << 31)
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        return frame.assign(sequence_id=sequence, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    full = found.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("place").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = part.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(rest)
