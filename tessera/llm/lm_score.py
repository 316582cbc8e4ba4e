"""Language-model scores: context-tree weighting over bytes, beside an add-one unigram baseline.

How it scales: neither the tree nor the unigram counts are ever gathered. Blocks of documents send each of their different words, and each different byte with the
DEPTH bytes before it, once to a bucket, where counts of all blocks meet; buckets grow in number with the input. A bucket of contexts holds whole subtrees, those
below the nearest `near` bytes. It weights them from the leaves up; the few levels above them are weighted on the driver and come back, and the bucket then has
the sums for each block's documents. A task adds up those of all its buckets before it sends them: there are more buckets than tasks, and few documents miss one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import saved, shuffles_freed
from tessera.llm.textbytes import LOWER, mix, representatives, slices, span_hashes, spans

#: Bytes of context. Eight of them and the symbol's node would not fit into 64 bits.
DEPTH = 6
#: Different bytes of the contexts in a dense `tree_table`.
CLASSES = 4
#: The symbol after the last byte of a text: 255, which is no byte of UTF-8.
END = 255
#: Bytes and documents of a block; bytes of input for a bucket of words, and for one of contexts; parts in which a block's contexts are packed.
BLOCK_BYTES, BLOCK_DOCS, BUCKET_BYTES, CONTEXT_BYTES, PARTS = 8 << 20, 65_000, 256 << 20, 16 << 20, 16
#: Tasks that buckets are dealt to, at least, and buckets of contexts for each of more; sums of documents that a task holds before it sends them.
TASKS, TASK_BUCKETS, HELD_SUMS = 64, 32, 16_000_000
#: From this size on, the optimizer's estimate is none, and the texts are measured.
ESTIMATED = 1 << 50
#: Different codes that a task holds before it sends their counts.
HELD_CODES = 2_000_000
#: Codes whose subtrees a task weights at once, about.
RANGE_CODES = 100_000
#: The end of a text as a unigram token.
END_TOKEN = np.uint64(1)

#: What a byte is as a context: itself, all told apart. What precedes a text is 0.
CLASS = np.arange(256)
#: Codes are spread by an odd factor where they serve as hashes.
_SPREAD = 0x9E3779B97F4A7C15
_GATHER = np.uint64(pow(_SPREAD, -1, 1 << 64))
_SPREAD = np.uint64(_SPREAD)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context * 256 + symbol for each byte of each text and its end, where each text begins there). The last byte is the highest digit of the context."""
    symbols = np.insert(data, offsets[1:], END)
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    past = np.append(np.zeros(DEPTH + 1, np.uint8), symbols)
    code = np.ndarray(len(symbols), "<u8", past, 0, (1,)) & np.uint64((1 << 8 * DEPTH) - 1 << 8) | symbols  # the eight bytes up to each symbol
    for place in range(DEPTH):  # what precedes a text there is none of it
        first = begins[np.diff(offsets) >= place] + place
        code[first] &= np.uint64(255 | (1 << 8 * place) - 1 << 8 * (DEPTH - place) + 8)
    return code, begins


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series from x + 8."""
    small = x.copy()
    for k in range(1, 8):
        small *= x + k
    z = x + 8
    w = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - w / 1260) * w) / z - np.log(small)


def log_kt(n: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov estimate of a block of bits with counts n[..., 0] and n[..., 1]."""
    return lgamma(n[..., 0] + 0.5) + lgamma(n[..., 1] + 0.5) - np.log(np.pi) - lgamma(n[..., 0] + n[..., 1] + 1)


def next_kt(n: np.ndarray) -> np.ndarray:
    return (n + 0.5) / (n.sum(-1, keepdims=True) + 1)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability of a node, weight of its own estimate) from its own log estimate and the sum of its children's weighted ones."""
    total = np.logaddexp(own, below) + np.log(0.5)
    return total, np.exp(own + np.log(0.5) - total)


def leaves(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the k-th bit of the symbols of ascending codes: sorted keys (the bits before it, then the context), counts[..., 2] of that bit at each, and for each code its key's place and its bit."""
    upto = code >> np.uint64(8 - k)
    new = np.append(True, upto[1:] != upto[:-1])
    one = code[new]
    bits = ((one & np.uint64(255)) >> np.uint64(8 - k)).astype(np.uint8)
    order = np.argsort(bits, kind="stable")  # contexts ascend already
    keys = (bits.astype(np.uint64) << np.uint64(8 * DEPTH) | one >> np.uint64(8))[order]
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place = rank[np.cumsum(new) - 1]
    bit = (code >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
    return keys, np.bincount(2 * place + bit, weights=n, minlength=2 * len(keys)).reshape(-1, 2), place, bit


def ascend(key: np.ndarray, n: np.ndarray, total: np.ndarray, times: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """From nodes (sorted key, counts, log of the weighted probability) to those `times` bytes of context above: the steps (place of each child's parent, the parents'
    estimates and weights), and the same three of the uppermost. A node without counts changes nothing."""
    steps = []
    for _ in range(times):
        key = key >> np.uint64(8)
        new = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        key, n = key[start], np.add.reduceat(n, start, axis=0)
        total, weight = weighted(log_kt(n), np.add.reduceat(total, start))
        steps.append((np.cumsum(new) - 1, next_kt(n), weight))
    return steps, key, n, total


def descend(steps: list, p: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The way back: from what the path above the uppermost nodes gives to both bits, and what weight it leaves, to the same above the lowest."""
    for place, own, weight in reversed(steps):
        p, rest = p + (rest * weight)[:, None] * own, rest * (1 - weight)
        p, rest = p[place], rest[place]
    return p, rest


def ranges(code: np.ndarray, near: int) -> Iterator[tuple[int, int]]:
    """Stretches of ascending codes, about RANGE_CODES long, none of which parts codes with the same last `near` bytes."""
    unit = code >> np.uint64(8 * (DEPTH - near) + 8)
    start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    start = start[np.unique(start // RANGE_CODES, return_index=True)[1]]
    return zip(start.tolist(), [*start[1:].tolist(), len(code)], strict=True)


def subtrees(code: np.ndarray, n: np.ndarray, near: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit of a symbol the nodes of `near` bytes of context: key, counts, log of the weighted probability; from different codes and how often they were trained on."""
    out = [[] for _ in range(8)]
    for a, b in ranges(code, near):
        for k in range(8):
            key, counts, _, _ = leaves(code[a:b], n[a:b], k)
            out[k].append(ascend(key, counts, log_kt(counts), DEPTH - near)[1:])
    return [tuple(map(np.concatenate, zip(*parts, strict=True))) for parts in out]


def upper(nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], near: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit the keys of those nodes, what the path above each gives to both bits, and the weight that it leaves."""
    out = []
    for key, n, total in nodes:
        order = np.argsort(key)
        steps, root, _, _ = ascend(key[order], n[order], total[order], near)
        out.append((key[order], *descend(steps, np.zeros((len(root), 2)), np.ones(len(root)))))
    return out


def code_logs(code: np.ndarray, n: np.ndarray, near: int, above: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The log10 probability of the symbol of each code in its context.

    For each of the 255 binary decisions there is one context tree. A node's weighted probability is half its own estimate and half the product of its children's;
    given the training text, the next bit's probability mixes the estimates along the path with the posterior weights that follow.
    """
    out = np.zeros(len(code))
    for a, b in ranges(code, near):
        for k in range(8):
            key, counts, place, bit = leaves(code[a:b], n[a:b], k)
            steps, top, _, _ = ascend(key, counts, log_kt(counts), DEPTH - near)
            known, p, rest = above[k]
            at = np.searchsorted(known, top)
            p, rest = descend(steps, p[at], rest[at])
            out[a:b] += np.log10(p + rest[:, None] * next_kt(counts))[place, bit]
    return out


def tree_table(counts: np.ndarray) -> np.ndarray:
    """(CLASSES ** DEPTH, 256) log10 probabilities of the next symbol after training on (context, symbol) counts of contexts of CLASSES different bytes."""
    row = np.arange(len(counts), dtype=np.uint64)
    context = np.zeros(len(counts), np.uint64)
    for _ in range(DEPTH):  # the last byte is the lowest digit of the row
        context = context << np.uint64(8) | row % np.uint64(CLASSES)
        row //= np.uint64(CLASSES)
    code = (context[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()
    order = np.argsort(code)
    code, n, out = code[order], counts.ravel()[order], np.empty(len(code))
    out[order] = code_logs(code, n, 0, upper(subtrees(code, n, 0), 0))
    return out.reshape(counts.shape)


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of like bytes, compressed; how many bytes of them there are comes first."""
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unplaned(blob: bytes, *kinds: tuple[type | str, int]) -> list[np.ndarray]:
    """Those arrays again, from the type and length of each."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending values, which np.cumsum undoes."""
    return np.diff(x, prepend=x.dtype.type(0))


def homes(code: np.ndarray, near: int, buckets: int) -> np.ndarray:
    """The bucket of each code: all with the same last `near` bytes share one."""
    return mix(code >> np.uint64(8 * (DEPTH - near) + 8)) % np.uint64(buckets)


def _coded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little") // 12
    code, times = _unplaned(blob, (np.uint64, n), (np.uint32, n))
    return np.cumsum(code, dtype=np.uint64), times


def upper_levels(texts: DataFrame, near: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`upper` for all codes of `texts` (text, trained). Of the tree, only nodes of `near` bytes of context come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept, count = [], 0, [], 0

        def fold() -> None:
            nonlocal held, size, count
            if held:
                both, times = np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
                code = both >> np.uint64(1)
                new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                kept.append((code[new], np.add.reduceat(times * (both & np.uint64(1)).astype(np.int64), new).astype(np.uint32)))
                count += len(new)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal kept, count
            fold()
            if kept:
                code, n, _ = _merged(kept)
                kept, count = [], 0
                home = homes(code, near, buckets)
                order = np.argsort(home, kind="stable")
                edges = np.searchsorted(home[order], np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(edges)):
                    own = order[edges[b] : edges[b + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int64()), pa.array([_planes(_steps(code[own]), n[own].astype(np.uint32))], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            trained = np.array(batch.column(1).to_pylist(), bool)
            for a, b, data, offsets in slices(batch.column(0)):
                if size + len(data) > BLOCK_BYTES:
                    fold()
                    if count > HELD_CODES:
                        yield from flush()
                code, _ = codes(LOWER[data], offsets)
                held.append(code << np.uint64(1) | np.repeat(trained[a:b], np.diff(offsets) + 1))
                size += len(data)
        yield from flush()

    def weigh(group: pa.Table) -> pa.Table:
        code, n = _totals(_coded(x.as_buffer()) for x in group.column("blob"))
        nodes = subtrees(code, n, near)
        return pa.table([pa.array(np.repeat(np.arange(8), [len(x[0]) for x in nodes]), pa.int32()), pa.array(np.concatenate([x[0] for x in nodes]).view(np.int64)), *(pa.array(np.concatenate([x[1][:, b] for x in nodes])) for b in (0, 1)), pa.array(np.concatenate([x[2] for x in nodes]))], names=["k", "key", "zeros", "ones", "total"])

    with shuffles_freed(texts.sparkSession):
        found = texts.mapInArrow(run, "bucket long, blob binary").groupBy("bucket").applyInArrow(weigh, "k int, key long, zeros double, ones double, total double").toArrow()
    k, key, zeros, ones, total = (x.to_numpy() for x in found.columns)
    return upper([(key[k == j].view(np.uint64), np.stack([zeros[k == j], ones[k == j]], axis=1), total[k == j]) for j in range(8)], near) if len(k) else []


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different hashes, how often each was trained on, the place of each part's hashes among them) of parts (hashes, counts, ...)."""
    distinct, which = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return distinct, np.bincount(which, weights=np.concatenate([x[1] for x in parts]), minlength=len(distinct)), which.astype(np.int32)


def _totals(parts: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(different hashes, how often each was trained on) of parts (hashes, counts, ...), few of which are held at once."""
    known, held, size = (np.zeros(0, np.uint64), np.zeros(0)), [], 0
    for part in parts:
        held.append(part[:2])
        size += len(part[0])
        if size > max(HELD_CODES, len(known[0])):
            known, held, size = _merged([known, *held])[:2], [], 0
    return _merged([known, *held])[:2]


def alike(counts: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """An order of documents by the main direction in which their symbols[document, class] differ, those trained on first. What like documents share is then listed in short steps."""
    share = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    share -= share.mean(0)
    return np.lexsort((share @ np.linalg.eigh(share.T @ share)[1][:, -1], ~trained))


def _packed(block: list[tuple[np.ndarray, np.ndarray]], docs: int, trained: int, buckets: int, factor: np.uint64 = np.uint64(1), home=lambda h, buckets: h % np.uint64(buckets)) -> Iterator[tuple[int, bytes]]:
    """For each bucket the block's different words (or codes) there: hash times `factor`, and (document, count) pairs; of `docs` documents the first `trained` are trained on."""
    words = np.concatenate([w for w, _ in block])
    doc = np.concatenate([d for _, d in block])
    first, token = representatives(words)
    hashes = words[first] * factor
    place = home(hashes, buckets)
    order = np.lexsort((hashes, place))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    hashes = hashes[order]
    pair, times = np.unique(rank[token] * docs + doc, return_counts=True)
    token, doc = np.divmod(pair, docs)
    bounds = np.searchsorted(token, np.arange(len(hashes) + 1))
    edges = np.searchsorted(place[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)):
        x, y = edges[b], edges[b + 1]
        u, v = bounds[x], bounds[y]
        wide = np.dtype("u1" if times[u:v].max() < 256 else "u4")
        head = np.array([y - x, v - u, wide.itemsize, trained], np.uint32)
        near = np.diff(doc[u:v], prepend=0)  # from one document of a word to the next
        near[bounds[x:y] - u] = doc[bounds[x:y]]
        yield int(b), head.tobytes() + _planes(_steps(hashes[x:y]), np.diff(bounds[x : y + 1]).astype(np.uint32), near.astype(np.uint16), times[u:v].astype(wide))


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    n, m, wide, trained = np.frombuffer(blob, np.uint32, 4).tolist()
    hashes, pairs, near, times = _unplaned(blob[16:], (np.uint64, n), (np.uint32, n), (np.uint16, m), (f"u{wide}", m))
    total, first = np.cumsum(near, dtype=np.int64), np.cumsum(pairs, dtype=np.int64) - pairs
    doc = total - np.repeat(total[first] - near[first], pairs)
    doc = doc.astype(np.uint16)
    train = np.add.reduceat(times * (doc < trained), first, dtype=np.int64).astype(np.uint32)
    return np.cumsum(hashes, dtype=np.uint64), train, pairs, doc, times


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket, from batches whose first column is the bucket, in order of it."""
    held, last = [], None
    for batch in batches:
        key = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip([0, *edges], [*edges, len(key)], strict=True) if len(key) else ():
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, ..., sums, ..., deep) of a task, the deep ones of a block added up to one; others as they come. What is sent for contexts so follows the tasks, not the buckets."""
    held, size, last = {}, 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        for block, sums in held.items():
            one = {"block": block, "sums": _planes(sums), "tokens": 0, "kinds": 0, "deep": True}
            yield pa.RecordBatch.from_arrays([pa.array([one.get(f.name)], f.type) for f in last], schema=last)
        held, size = {}, 0

    for batch in batches:
        last, deep = batch.schema, batch.column("deep")
        yield batch.filter(pc.invert(deep))
        own = batch.filter(deep)
        for block, blob in zip(own.column("block").to_pylist(), own.column("sums"), strict=True):
            blob = blob.as_buffer()
            n = len(blob) // 10
            doc, sums = np.frombuffer(blob, np.uint16, n, 8 * n), held.get(block, np.zeros(0))
            if len(sums) <= doc[-1]:
                size += int(doc[-1]) + 1 - len(sums)
                held[block] = sums = np.append(sums, np.zeros(doc[-1] + 1 - len(sums)))
            sums[doc] += np.frombuffer(blob, float, n)
        if size > HELD_SUMS:
            yield from flush()
    yield from flush()


#: What each document has beside its sums.
_LISTS = "doc_id array<{}>, held_out array<boolean>, n_tokens array<long>, n_bytes array<long>"


def scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of `docs` (doc_id, text; others are not read).

    Training documents are those whose crc32(doc_id as text) mod `folds` is not `held`. A-Z count as lower case. Tokens are words and one end; base_score sums
    log10((c + 1) / (N + V + 1)). score is the tree's log10 probability of the text's bytes and its end; bits_per_byte is that code length for each of them.
    Words are told apart by 64-bit hashes. Defined cases: a null text is an empty one; a null doc_id is neither held out nor trained on; repeated rows count as
    often as they come; without training documents base_score is 0 and score that of fair bits; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    docs = docs.select("doc_id", "text", F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.coalesce(fold != held, F.lit(False)).alias("trained"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= ESTIMATED:
        with shuffles_freed(spark):
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, size // BUCKET_BYTES)
    branches = max(32, size // CONTEXT_BYTES)
    near = 2 + (branches > 64) + (branches > 1024)  # more buckets need smaller subtrees
    above = spark.sparkContext.broadcast(upper_levels(docs.select("text", "trained"), near, branches))
    lists = _LISTS.format(kind)
    schema = f"bucket long, block long, blob binary, {lists}"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        words, contexts, ids, flags, trained, totals, sizes, symbols, held_bytes = [], [], [], [], [], [], [], [], 0

        def branch(k: int, rank: np.ndarray, learned: int) -> Iterator[tuple[int, bytes]]:
            """A part of the block's contexts: every PARTS-th bucket."""
            own = [(code[edges[k] : edges[k + 1]] * _SPREAD, rank[doc[edges[k] : edges[k + 1]]]) for code, doc, edges in contexts]
            if sum(len(x) for x, _ in own):
                yield from _packed(own, len(rank), learned, branches, _GATHER, lambda code, n: homes(code, near, n))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, words, contexts, ids, flags, trained, totals, sizes, symbols, held_bytes
            if not totals:
                return
            learn = np.concatenate(trained)
            order = alike(np.concatenate(symbols), learn)
            rank, learned = np.empty_like(order), int(learn.sum())
            rank[order] = np.arange(len(order))
            own = [x.take(pa.array(order)) for x in (pa.concat_arrays(ids), pa.concat_arrays(flags), pa.array(np.concatenate(totals)), pa.array(np.concatenate(sizes)))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - number]), pa.array([number]), pa.array([None], pa.binary()), *lists], names)
            for b, blob in itertools.chain(_packed([(w, rank[d]) for w, d in words], len(rank), learned, buckets), ((buckets + b, blob) for k in range(PARTS) for b, blob in branch(k, rank, learned))):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([number]), pa.array([blob], pa.binary()), *(pa.nulls(1, x.type) for x in lists)], names)
            number += 1
            words, contexts, ids, flags, trained, totals, sizes, symbols, held_bytes = [], [], [], [], [], [], [], [], 0

        names, count = [x.split()[0] for x in schema.split(", ")], 0
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                for c in range(a, b, BLOCK_DOCS):
                    rows = min(b, c + BLOCK_DOCS) - c
                    part = offsets[c - a : c - a + rows + 1]
                    low, part = LOWER[data[part[0] : part[-1]]], part - part[0]
                    count = sum(map(len, totals))
                    if held_bytes + len(low) > BLOCK_BYTES or count + rows > BLOCK_DOCS:
                        yield from flush()
                        count = 0
                    starts, ends, firsts = spans(low, part)
                    own = np.diff(firsts)
                    words.append((np.append(span_hashes(low, starts, ends), np.full(rows, END_TOKEN)), count + np.append(np.repeat(np.arange(rows), own), np.arange(rows))))
                    code = codes(low, part)[0]
                    share = (homes(code, near, branches) % np.uint64(PARTS)).astype(np.uint8)
                    order = np.argsort(share, kind="stable")
                    doc = np.repeat((count + np.arange(rows)).astype(np.uint16), np.diff(part) + 1)
                    contexts.append((code[order], doc[order], np.searchsorted(share[order], np.arange(PARTS + 1))))
                    symbols.append(np.bincount(np.repeat(np.arange(rows) * 64, np.diff(part)) + low % 64, minlength=64 * rows).reshape(rows, 64).astype(np.float32))
                    totals.append(own + 1)
                    sizes.append(np.diff(part))
                    ids.append(batch.column(0).slice(c, rows))
                    flags.append(batch.column(2).slice(c, rows))
                    trained.append(np.array(batch.column(3).slice(c, rows).to_pylist(), bool))
                    held_bytes += len(low)
        yield from flush()

    def bucket(group: pa.Table) -> pa.Table:
        if group.column("blob")[0].as_py() is None:  # a block's own row
            own = group.select(["block", *(x.split()[0] for x in lists.split(", "))])
            return own.append_column("sums", pa.nulls(len(own), pa.binary())).append_column("tokens", pa.nulls(len(own), pa.int64())).append_column("kinds", pa.nulls(len(own), pa.int64())).append_column("deep", pa.array([False] * len(own))).select(names)
        blobs = [x.as_buffer() for x in group.column("blob")]
        distinct, count = _totals(map(_unpacked, blobs))
        deep = group.column("bucket")[0].as_py() >= buckets
        logs, known = code_logs(distinct, count, near, above.value) if deep else np.log10(count + 1), count > 0
        out = []
        for hashes, _, pairs, doc, times in map(_unpacked, blobs):
            token = np.repeat(np.searchsorted(distinct, hashes), pairs)
            docs_, place = np.unique(doc, return_inverse=True)
            total = np.bincount(place, weights=logs[token] * times)
            seen = np.bincount(place, weights=known[token] * times).astype(np.uint32)
            out.append(total.tobytes() + docs_.tobytes() if deep else _planes(total, seen, _steps(docs_)))
        n = len(blobs)
        own = [pa.array([0 if deep else int(x.sum())] + [0] * (n - 1)) for x in (count, known)] + [pa.array([deep] * n)]
        return pa.table([group.column("block"), *(pa.nulls(n, group.column(x.split()[0]).type) for x in lists.split(", ")), pa.array(out, pa.binary()), *own], names=names)

    names = ["block", *(x.split()[0] for x in lists.split(", ")), "sums", "tokens", "kinds", "deep"]
    parts = f"block long, {lists}, sums binary, tokens long, kinds long, deep boolean"

    def joined(group: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in group.column("sums")]
        own = blobs.index(None)
        cols = {name: group.column(name).combine_chunks().slice(own, 1).flatten() for name in names[1:5]}
        rows = len(cols["doc_id"])
        base, score, known = np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64)
        for blob, deep in zip(blobs, group.column("deep").to_pylist(), strict=True):
            if blob is None:
                continue
            m = int.from_bytes(blob[:8], "little") // (8 if deep else 14)
            if deep:
                score[:m] += _unplaned(blob, (float, m))[0]
            else:
                total, seen, doc = _unplaned(blob, (float, m), (np.uint32, m), (np.uint16, m))
                doc = np.cumsum(doc, dtype=np.uint16)
                base[doc] += total
                known[doc] += seen
        length = -score * np.log2(10) / (cols["n_bytes"].to_numpy() + 1)
        found = [pa.array([pc.sum(group.column(x)).as_py() or 0] + [0] * (rows - 1), pa.int64()) for x in ("tokens", "kinds")]
        return pa.table([cols["doc_id"], cols["held_out"], cols["n_tokens"], pa.array(known), pa.array(base), pa.array(score), pa.array(length), *found], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bits_per_byte", "tokens", "kinds"])

    rows = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, bits_per_byte double, tokens long, kinds long"
    with shuffles_freed(spark):
        dealt = docs.mapInArrow(blocks, schema).repartition(max(TASKS, branches // TASK_BUCKETS), "bucket").sortWithinPartitions("bucket")
        sums = dealt.mapInArrow(lambda batches: combined(x for group in runs(batches) for x in bucket(group).to_batches()), parts)
        out = saved(sums.groupBy("block").applyInArrow(joined, rows), "scores")
        n, v = (x or 0 for x in out.agg(F.sum("tokens"), F.sum("kinds")).first())
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "bits_per_byte")
