"""Near-duplicate documents: banded MinHash candidates, odd sketches to sift them, exact shingle sets to confirm them.

How it scales: one narrow pass turns each text into a fixed-size record (set hash, band keys, sketch). Equal sets fold into one class first, so copies never meet
each other again. In a bucket of like band keys every class is compared with one hub, then, where it is still apart, with a few hubs drawn by hash. Only classes
that are then still in different components of one bucket are compared with each other: blocks of a bounded number of classes meet two at a time, and each class
proposes the few partners that its sketches show nearest. What is confirmed contracts, what is refuted is not proposed again, and the rounds go on until nothing is
left to propose. So a group of near copies costs stars and a few proposals a class, not all its pairs, and no link between different texts is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.store import released, saved, temporary
from tessera.llm.textbytes import LOWER, mix, slices, span_hashes, spans, windows

#: Bands of the MinHash signature and samples in each: two sets of similarity 0.8 miss each other in all bands 3 times in a million, of 0.85 twice in ten million.
BANDS, ROWS = 24, 4
#: MinHash samples folded into the sketch (the bands use the first of them) and bits of the sketch; the same of the finer sketch that open buckets use.
SAMPLES, BITS, FINE_SAMPLES, FINE_BITS = 128, 512, 768, 2048
#: Bits of the sketch that folds in every member of a set, where each odd bit stands for one member at least that the two sets do not share.
WHOLE_BITS = 4096
#: A pair goes on to the exact check if its sketch shows at least the threshold less this (0 of 500,000 simulated pairs at 0.8 fail the finer one; at 0.06 it was 100).
SLACK, FINE_SLACK = 0.17, 0.09
#: Hubs drawn from a bucket that is still open, on average.
HUBS = 8
#: Partners that a class proposes in the first round over an open bucket, and how much more in each round after it.
PROPOSED, MORE = 8, 4
#: Documents to confirm whose ids may be broadcast (8 bytes each); more of them are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Classes in one block of a bucket (about 1 kB each), and pairs that are looked at together.
BLOCK, PAIRS = 4096, 1 << 16

_random = np.random.default_rng(7)
_TIMES = _random.integers(0, 1 << 31, FINE_SAMPLES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint32)[:, None]


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words, A-Z in lower case; of fewer words, one hash of all; of none, nothing."""
    for _, _, data, offsets in slices(column):
        starts, ends, firsts = spans(data, offsets)
        words = span_hashes(LOWER[data], starts, ends)
        runs = windows(words, width)
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            else:
                yield windows(words[a:b], max(1, int(b - a))) + np.uint64(b - a)


def samples(hashes: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """The MinHash samples of a set: for each of the first `count` permutations the least value."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 2048):
        np.minimum(least, (short[k : k + 2048] * _TIMES[:count] + _PLUS[:count]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys: equal where all samples of that band are."""
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(least), 1), np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k : BANDS * ROWS : ROWS].astype(np.uint64))
    return key


def odd_sketches(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(documents, bits / 64) words: a bit is set if an odd number of (place, sample) pairs hash to it."""
    place = np.arange(least.shape[1], dtype=np.uint64)[None, :] << np.uint64(32)
    bit = (mix(least.astype(np.uint64) + place) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    counts = np.bincount((bit + bits * np.arange(len(least))[:, None]).ravel(), minlength=bits * len(least))
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(least), bits), axis=1, bitorder="little").view(np.int64)


def whole_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, WHOLE_BITS / 64) words: a bit is set if an odd number of members hash to it."""
    bit = (mix(np.concatenate(sets)) >> np.uint64(64 - WHOLE_BITS.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(bit + WHOLE_BITS * np.repeat(np.arange(len(sets)), [len(x) for x in sets]), minlength=WHOLE_BITS * len(sets))
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(sets), WHOLE_BITS), axis=1, bitorder="little").view(np.int64)


def most_odd_bits(similarity: float, count: int = SAMPLES, bits: int = BITS) -> int:
    """Bits in which the sketches of two sets differ that still speak for at least `similarity`: each different sample flips two random bits."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * count * (1 - similarity) / bits)))


def _lists(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch) of each row; set_id, a 128-bit hash of the set, is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = 0
            sizes, ids, least = [], [], np.empty((batch.num_rows, SAMPLES), np.uint32)
            for sets, one in enumerate(shingle_sets(batch.column(1), width)):
                sizes.append(len(one))
                ids.append(blake2b(one.tobytes(), digest_size=16).digest() if len(one) else None)
                least[sets] = samples(one)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), _lists(band_keys(least)), _lists(odd_sketches(least))], ["doc_id", "n_shingles", "set_id", "bands", "sketch"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_id binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles, fine, whole) of each row with words: the whole set and its two finer sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                sets = [one for one in shingle_sets(batch.column(1).slice(a, 256), width) if len(one)]
                if sets:
                    ids = pa.array([blake2b(one.tobytes(), digest_size=16).digest() for one in sets], pa.binary())
                    fine = odd_sketches(np.stack([samples(one, FINE_SAMPLES) for one in sets]), FINE_BITS)
                    own = [ids, pa.array([one.view(np.int64) for one in sets], pa.list_(pa.int64())), _lists(fine), _lists(whole_sketches(sets))]
                    yield pa.RecordBatch.from_arrays(own, ["set_id", "shingles", "fine", "whole"])

    return docs.mapInArrow(run, "set_id binary, shingles array<long>, fine array<long>, whole array<long>")


def _similar(percent: int) -> Column:
    """What the sizes and the sketches of a pair allow."""
    odd = sum((F.bit_count(F.col("a_sketch")[k].bitwiseXOR(F.col("b_sketch")[k])) for k in range(BITS // 64)), F.lit(0))
    return (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent) & (odd <= most_odd_bits(percent / 100 - SLACK))


def _side(classes: DataFrame, side: str, *columns: str) -> DataFrame:
    return classes.select(F.col("set_id").alias(side), F.col("n_shingles").alias(f"{side}_n"), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def _texts_of(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(set_id, n_shingles, shingles, fine, whole) of the classes in `wanted` (set_id, doc_id), made again from one text of each."""
    wanted = saved(wanted, "wanted")
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= MAX_BROADCAST_IDS else ids
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = _sets(texts, width).join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])
    return saved(sets.select("set_id", F.size("shingles").cast("long").alias("n_shingles"), "shingles", "fine", "whole"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose full shingle sets are as similar as asked."""
    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("a_set")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("b_set")), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return saved(both.where(shared * 100 >= (F.size("a_set") + F.size("b_set") - shared) * percent).select("a", "b"), "links")


def _open(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """(band, set_id, component, members, main) of buckets whose classes are in several components; main is the largest of them there."""
    placed = saved(buckets.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").select("band", "set_id", "members", F.coalesce("component", "set_id").alias("component")), "placed")
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("largest")).where("parts > 1")
    return saved(placed.join(parts, "band").select("band", "set_id", "component", "members", F.col("largest.component").alias("main")), "open")


#: What a class has in a block of an open bucket.
_MEMBER = "band long, i int, j int, a boolean, b boolean, main boolean, part long, set_id binary, number long, n_shingles long, bands array<long>, fine array<long>, whole array<long>, refuted array<long>"


def _blocks(still: DataFrame, ends: DataFrame, refuted: DataFrame, hubs: bool) -> DataFrame:
    """_MEMBER rows of open buckets. Each class that is not in the largest component of its bucket looks, in its own block i (`a`), for partners in each block j (`b`); with `hubs` among a few that a hash draws, in one go."""
    salt = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = still.select("band", "set_id", F.xxhash64("set_id").alias("number"), F.xxhash64("component").alias("part"), (F.col("component") == F.col("main")).alias("main"), "members", salt.alias("salt"))
    rows = rows.withColumn("own", F.pmod("number", "salt").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("salt") - 1))
    drawn = F.pmod(F.xxhash64("number"), F.greatest(F.lit(1), F.floor(F.col("members") / HUBS))) == 0
    seeking = rows.where("not main").select("*", F.col("own").alias("i"), F.lit(-1).alias("j") if hubs else every.alias("j"), F.lit(True).alias("a"), F.lit(False).alias("b"))
    sought = (rows.where(drawn) if hubs else rows).select("*", every.alias("i"), F.lit(-1).alias("j") if hubs else F.col("own").alias("j"), F.lit(False).alias("a"), F.lit(True).alias("b"))
    names = [x.split()[0] for x in _MEMBER.split(", ")]
    return seeking.unionByName(sought).join(ends, "set_id").join(refuted, "set_id", "left").select(names).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).view(np.uint64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (band, i, j), which come one after the other."""
    left = None
    for batch in batches:
        if left is not None:
            batch = pa.concat_batches([left, batch])
        keys = [batch.column(k).to_numpy() for k in range(3)]
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
        edges = [0, *edges.tolist()]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(x, y - x)
        left = batch.slice(edges[-1])
    if left is not None and left.num_rows:
        yield left


def nearest(group: pa.RecordBatch, percent: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, whether the row has more) for each class of a block that looks for one: the `top` partners in other components that its sketches show nearest, of those that may be similar enough.

    A pair is looked at in the first band that it shares alone. The sketch of all members never shows more different ones than there are, so it loses no pair.
    """
    col = {name: group.column(k) for k, name in enumerate(group.schema.names)}
    flag = lambda name: col[name].to_numpy(zero_copy_only=False).astype(bool)
    seekers, others, part = np.flatnonzero(flag("a") & ~flag("main")), np.flatnonzero(flag("b")), col["part"].to_numpy()
    out: tuple[list, list, list] = ([], [], [])
    if not len(seekers) or not len(others):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    size, number = col["n_shingles"].to_numpy(), col["number"].to_numpy()
    bands, fine, whole = (_matrix(col[name]) for name in ("bands", "fine", "whole"))
    band = int(np.flatnonzero(bands[0].view(np.int64) == col["band"][0].as_py())[0])
    refuted = col["refuted"].to_pylist()
    most = most_odd_bits(percent / 100 - FINE_SLACK, FINE_SAMPLES, FINE_BITS)
    step = max(1, PAIRS // len(others))
    for at in range(0, len(seekers), step):
        some = seekers[at : at + step]
        apart = part[some][:, None] != part[others][None, :]
        for k in range(band):
            apart &= bands[some, k][:, None] != bands[others, k][None, :]
        x, y = np.nonzero(apart)
        x, y = some[x], others[y]
        like = np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * percent
        x, y = x[like], y[like]
        if not len(x):
            continue
        odd = np.bitwise_count(whole[x] ^ whole[y]).sum(axis=1, dtype=np.int64)
        like = odd * (100 + percent) <= (size[x] + size[y]) * (100 - percent)
        x, y, odd = x[like], y[like], odd[like]
        like = np.bitwise_count(fine[x] ^ fine[y]).sum(axis=1, dtype=np.int64) <= most
        x, y, odd = x[like], y[like], odd[like]
        new = np.array([not refuted[p] or number[q] not in refuted[p] for p, q in zip(x.tolist(), y.tolist(), strict=True)], bool)
        x, y, odd = x[new], y[new], odd[new]
        order = np.lexsort((number[y], odd, x))
        x, y = x[order], y[order]
        first = np.searchsorted(x, x, "left")
        now, more = np.arange(len(x)) - first < top, np.searchsorted(x, x, "right") - first > top
        for held, values in zip(out, (x, y, more), strict=True):
            held.append(values[now])
    return tuple(np.concatenate(held) if held else np.zeros(0, int) for held in out)


def _proposed(blocks: DataFrame, percent: int, top: int) -> DataFrame:
    """Pairs (a, b) of classes that may be linked, from _MEMBER rows: for each class `top` in a block at most; `more` says that it has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            x, y, more = nearest(group, percent, top)
            if len(x):
                ids = group.column("set_id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(more)], ["a", "b", "more"])

    found = blocks.mapInArrow(run, "a binary, b binary, more boolean")
    return found.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.bool_or("more").alias("more"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text; other columns, whatever their names, are not read).

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct runs of `width` words. component_id is the smallest doc_id reachable
    over links, the document's own included; kept says that it is the document's own. Defined cases: a null or wordless text has an empty set and is linked with
    nothing; rows of one doc_id and text are copies of each other, all kept or none; rows with a null doc_id take part, and are kept only where their whole
    component has none; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    with temporary() as tables:
        found = saved(features(docs, width), "features")
        classes = saved(found.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
        keys = classes.select("set_id", F.explode("bands").alias("band"))
        shared = keys.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
        buckets = saved(keys.join(shared, "band"), "buckets")

        hubs = buckets.groupBy("band").agg(F.min("set_id").alias("b"))
        stars = buckets.join(hubs, "band").where("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()
        tested = saved(stars.join(_side(classes, "a", "sketch"), "a").join(_side(classes, "b", "sketch"), "b").where(_similar(percent)).select("a", "b"), "pairs")
        ids = classes.select("set_id", "doc_id")
        links = _confirmed(tested, _texts_of(tested.select(F.col("a").alias("set_id")).union(tested.select("b")).distinct().join(ids, "set_id"), docs, width), percent)
        joined = components(links)

        still = _open(buckets, joined)
        sets = _texts_of(still.select("set_id").distinct().join(ids, "set_id"), docs, width)
        ends = sets.select("set_id", "n_shingles", "fine", "whole").join(classes.select("set_id", "bands"), "set_id")
        top, by_hubs = PROPOSED, True
        while still.limit(1).count():
            wrong = tested.join(links, ["a", "b"], "left_anti")
            wrong = wrong.union(wrong.select("b", "a")).groupBy(F.col("a").alias("set_id")).agg(F.collect_list(F.xxhash64("b")).alias("refuted"))
            pairs = saved(_proposed(_blocks(still, ends, wrong, by_hubs), percent, top), "pairs")
            if pairs.limit(1).count():
                tested = tested.union(pairs.select("a", "b"))
                links = links.union(_confirmed(pairs, sets, percent))
                joined = components(links)
            if not by_hubs and not pairs.where("more").limit(1).count():
                break  # every class has proposed all that may be linked with it
            still = _open(buckets, joined)
            top, by_hubs = top if by_hubs else top * MORE, False

        members = classes.select("set_id", "doc_id").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        members = saved(members, "members")
        released(tables, found, members)
    smallest = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = members.join(smallest, "component").select("set_id", "component_id")
    out = found.select("doc_id", "n_shingles", "set_id").join(ids, "set_id", "left").withColumn("component_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
