"""Language identification by cross-parsing: how few phrases of each language's labelled text a text falls into.

How it scales: a few kilobytes of text for each language come to the driver, chosen by hash; every worker builds their suffix automata once. Prediction is one narrow
pass in which thousands of stretches of text walk the automata in step, so Python does a handful of array operations for thousands of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import slices, spread

#: Labelled text of a language in bytes, documents that it is taken from, and characters of a longer one, in stretches spread over it.
LEARNED_BYTES, LEARNED_DOCS, LEARNED_LONGEST = 24_000, 64, 20_000
#: Bytes of a stretch: a parse begins anew at its start, which adds a phrase at most, for each language alike.
STRETCH, SLICE_BYTES = 1024, 4 << 20

#: Symbol of each byte: letters and what is beyond ASCII are told apart, all else is 0.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[0x80:] = np.arange(27, 155)
SYMBOLS = 155


def automaton(text: np.ndarray) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """(transitions, suffix links, lengths) of the suffix automaton of a sequence of symbols: it reads exactly its substrings, from state 0."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        state = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = state
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return go, link, length


def walker(text: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The automaton as a table for parsing, flat: entry [state + symbol] is the next state (a multiple of the row length) times 2, plus 1 if a phrase begins.

    A phrase goes on while the automaton can read; else the symbol begins a new phrase, and if the text lacks it altogether, is one by itself.
    """
    go = automaton(symbols[text])[0]
    width = int(symbols.max()) + 1
    table = np.full((len(go), width), -1, np.int32)
    for state, out in enumerate(go):
        table[state, list(out.keys())] = list(out.values())
    fresh = np.maximum(table[0], 0) * width * 2 + 1
    out = np.where(table < 0, fresh, table * width * 2)
    out[0] = fresh
    return out.ravel().astype(np.int32)


def phrases(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """(languages, texts) numbers of phrases."""
    pieces = -(-np.diff(offsets) // STRETCH)
    text = np.repeat(np.arange(len(pieces)), pieces)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH + offsets[:-1][text]
    size = np.minimum(begin + STRETCH, offsets[1:][text]) - begin
    order = np.argsort(-size, kind="stable")
    begin, size, text = begin[order], size[order], text[order]
    live = np.searchsorted(-size, -np.arange(STRETCH), "left") if len(size) else np.zeros(STRETCH, int)
    read = np.concatenate([symbols[data], np.zeros(STRETCH, symbols.dtype)]).astype(np.int32)
    out = np.zeros((len(tables), len(pieces)))
    for k, table in enumerate(tables):
        state, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
        for step in range(int(size[0]) if len(size) else 0):
            n = live[step]
            found = table[state[:n] + read[begin[:n] + step]]
            count[:n] += found & 1
            state[:n] = found >> 1
        out[k] = np.bincount(text, count, len(pieces))
    return out


def learned(docs: DataFrame, folds: int = 4, held: int = 2) -> dict[str, bytes]:
    """For each language the first LEARNED_BYTES of lower-cased text from LEARNED_DOCS documents at most, those with the least hashes in as many slots.

    Only rows with lang and text whose crc32(doc_id as text) mod `folds` is not `held` count; of rows of one lang and doc_id, the least text. What comes to the
    driver is LEARNED_DOCS texts of LEARNED_LONGEST characters for each language at most.
    """
    docs = docs.withColumn("text", spread("text", LEARNED_LONGEST))
    usable = docs.where((F.crc32(F.col("doc_id").cast("string")) % folds != held) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("slot", F.pmod("h", F.lit(LEARNED_DOCS)))
    slots = hashed.groupBy("lang", "slot").agg(F.min(F.struct("h", "doc_id")).alias("least"))
    picked = slots.select("lang", "least.doc_id").collect()
    if not picked:
        return {}
    ids = docs.sparkSession.createDataFrame(picked, f"lang string, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    rows = usable.select("lang", "doc_id", "text").join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text)):
        out[r.lang] = (out.get(r.lang, b"") + pc.utf8_lower(pa.scalar(r.text)).as_py().encode() + b"\n")[:LEARNED_BYTES]
    return out


_tables: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}


def identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text, lang; others are not read, and lang only to learn).

    The language whose text needs the fewest phrases, each at log2 of that text's length, wins; equals go to the first in order. score is its weight among all
    languages when each bit saved doubles it. Defined cases: a null text, one without a letter, and any text when nothing could be learned, is `und` with score 0;
    a null doc_id is not held out; repeated rows get equal predictions; an empty table gives no rows.
    """
    texts = learned(docs.select("doc_id", "text", "lang"), folds, held)
    langs = sorted(texts)
    # letters and signs that no language's text has are one symbol
    used = np.unique(SYMBOL[np.frombuffer(b"".join(texts.values()), np.uint8)])
    symbols = np.where(np.isin(SYMBOL, used), np.searchsorted(used, SYMBOL), len(used))
    cost = np.array([np.log2(len(texts[x]) + 1) for x in langs])
    key = hash((tuple(langs), tuple(texts[x] for x in langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _tables:
            _tables.clear()
            _tables[key] = [walker(np.frombuffer(texts[x], np.uint8), symbols) for x in langs]
        for batch in batches:
            lower = pc.utf8_lower(pc.fill_null(batch.column(2), ""))
            letters = pc.match_substring_regex(lower, r"\p{L}").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(lower, SLICE_BYTES):
                letter = letters[a:b] & bool(langs)
                bits = phrases(data, offsets, _tables[key], symbols) * cost[:, None] if langs else np.zeros((1, b - a))
                best = bits.argmin(axis=0)
                weight = 1 / np.exp2(np.maximum(bits.min(axis=0) - bits, -1000)).sum(axis=0)
                pred = pa.array([langs[k] if x else "und" for k, x in zip(best.tolist(), letter.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pred, pa.array(np.where(letter, weight, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    out = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)).alias("held_out"), "text")
    return out.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
