"""Exact removal of repeated 100-byte strings by prefix-free parsing.

A rolling hash of every `GRAM` bytes makes the triggers: the trigger of a 100-byte
string is its `GRAM` bytes of least hash by 43 bits (the leftmost, if equal), so equal
strings have equal triggers at equal places, whatever surrounds them. The strings
of one trigger form a phrase: consecutive starts, and the bytes they reach. A text
is parsed into phrases, and a phrase occurs again wherever its trigger does.

1. Triggers that occur once cannot carry a repeat. They are counted by hash.
2. Phrases of the other triggers are classed by content. Every occurrence of a
   phrase but the first in corpus order (doc_id, start) repeats as a whole.
3. Where one trigger has several phrases, these are the dictionary. Its suffixes
   from the trigger on are sorted, and so are its prefixes read backwards from the
   trigger: two suffix arrays, range-partitioned. The common lengths of neighbours
   tell which strings of a phrase another phrase can share. For those the parse,
   that is the corpus order of the phrases, gives the first occurrence; every
   other one repeats.
4. The bytes of all repeats are cut out of their documents.

Everything is judged on the input. Steps 1 to 3 aggregate before they shuffle,
so a passage in a third of all documents makes no large task, and a task holds
one slice of text. Contents are compared by 128 bits of hashes where slices meet.

Null text counts as empty. Texts under 100 bytes lose nothing. Rows without
doc_id lose nothing and make nothing repeat. Rows that repeat a doc_id with the
same text are one document and are cut alike; with other texts they are versions
of one document, of which equal starts count once. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import map_texts, texts_of
from textward.session import Scratch

SPAN, GRAM = 100, 40
TRIGGERS = SPAN - GRAM + 1
#: Starts that are parsed at once in a very long text; a phrase may end there, which is harmless.
_SEGMENT = 1 << 20
#: The bits of a place in a segment; the hashes that are compared have the others.
_LOW = np.uint64((1 << (_SEGMENT + SPAN).bit_length()) - 1)
_BASES = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def _codes(which: int) -> np.ndarray:
    return np.random.default_rng(97 + which).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(_BASES[0], -1, 2**64))
    size = _SEGMENT + SPAN
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, b))), dtype=np.uint64) for b in (np.uint64(_BASES[0]), inverse))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every string of `size` bytes, by doubling."""
    power, width, have, done = _BASES[which], 1, _codes(which)[data], None
    used, left = 0, size
    while left:
        if left & 1:
            part = have[used : used + len(data) - size + 1]
            done = part.copy() if done is None else done * np.uint64(power) + part
            used += width
        left >>= 1
        if left:
            have = have[:-width] * np.uint64(power) + have[width:]
            power, width = power * power % 2**64, 2 * width
    return _spread(done)


def least_at(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` hashes the position of its minimum by the upper bits, the leftmost if equal.

    The lower bits make room for the position, so a minimum brings its place along.
    """
    n = len(hashes) - window + 1
    best, width = hashes & ~_LOW | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * width <= window:
        best = np.minimum(best[width:], best[:-width])
        width *= 2
    shift = window - width
    return ((np.minimum(best[shift : shift + n], best[:n]) if shift else best[:n]) & _LOW).astype(np.int64)


def _parse(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(base, start, number of starts, hash of the trigger, place of the trigger) of the phrases of a text, by segment, from its base."""
    for base in range(0, len(data) - SPAN + 1, _SEGMENT):
        hashes = rolling(data[base : base + _SEGMENT + SPAN - 1], GRAM)
        at = least_at(hashes, TRIGGERS)
        start = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        yield base, start, np.diff(start, append=len(at)), hashes[at[start]].view(np.int64), at[start]


def phrases(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, number of starts, hash of the trigger, hash of the content, place of the trigger after the start) of the phrases of a text, by segment."""
    for base, start, count, key, at in _parse(data):
        part = data[base : base + _SEGMENT + SPAN - 1]
        powers, back = _powers()
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_codes(1)[part] * powers[: len(part)], dtype=np.uint64)))
        content = _spread((sums[start + count + SPAN - 1] - sums[start]) * back[start] + count.astype(np.uint64))
        yield start + base, count, key, content.view(np.int64), at - start


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.empty(0, np.uint8)


def _trigger_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, key, times): the triggers of every document, each once, and whether it has one more than once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, keys, times = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = _bytes(text)
            if len(data) >= SPAN:
                key, n = np.unique(np.concatenate([x[3] for x in _parse(data)]), return_counts=True)
                docs.append(np.full(len(key), doc)), keys.append(key), times.append(np.minimum(n, 2))
        if not docs:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(times).astype(np.int32))], ["doc_id", "key", "times"])

    return map_texts(texts.where("doc_id is not null"), work, "doc_id long, key long, times int")


def _phrase_rows(joined: DataFrame) -> DataFrame:
    """(doc_id, start, n, key, content) of the phrases whose trigger is among the document's `keys`."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            wanted = np.sort(keys.values.to_numpy())
            for start, n, key, content, _ in phrases(_bytes(text)):
                hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                out.append((np.full(hit.sum(), doc), start[hit], n[hit], key[hit], content[hit]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc_id", "start", "n", "key", "content"])

    return map_texts(joined.select("doc_id", "text", "keys"), work, "doc_id long, start long, n long, key long, content long")


def _dictionary(joined: DataFrame) -> DataFrame:
    """(key, doc_id, start, n, place, back, ahead): the dictionary phrases, as the bytes before the trigger, backwards, and those from it on."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data, pairs = _bytes(text), {(w["start"], w["n"]) for w in wanted}
            whole = data.tobytes()
            starts = np.array(sorted({a for a, _ in pairs}))
            for base, start, n, key, at in _parse(data):
                for i in np.flatnonzero(np.isin(start + base, starts)).tolist():
                    a, k, m = int(start[i]) + base, int(n[i]), int(at[i] - start[i])
                    if (a, k) in pairs:
                        rows.append((int(key[i]), doc, a, k, m, whole[a : a + m][::-1], whole[a + m : a + k + SPAN - 1]))
        if not rows:
            return None
        kinds = [pa.int64()] * 5 + [pa.binary()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "doc_id", "start", "n", "place", "back", "ahead"])

    return map_texts(joined.select("doc_id", "text", "wanted"), work, "key long, doc_id long, start long, n long, place long, back binary, ahead binary")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _shared(rows: DataFrame, side: str, out: str) -> DataFrame:
    """`rows` with the longest common prefix of `side` with any other row of the key.

    Sorted by key and side, that is the longer one with the two neighbours. At the
    ends of a partition, whose neighbour is elsewhere, the whole length is assumed:
    a string too many is only compared in vain.
    """
    ready = rows.repartitionByRange("key", side).sortWithinPartitions("key", side)
    names = ready.columns
    k, s = names.index("key"), names.index(side)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def lengths(batch: pa.RecordBatch, before: tuple | None, after: tuple | None) -> pa.RecordBatch:
            keys, values = batch.column(k).to_pylist(), batch.column(s).to_pylist()
            link = [common(a, b) if x == y else 0 for x, y, a, b in zip(keys, keys[1:], values, values[1:], strict=False)]
            head = len(values[0]) if before is None else (common(before[1], values[0]) if before[0] == keys[0] else 0)
            tail = len(values[-1]) if after is None else (common(after[1], values[-1]) if after[0] == keys[-1] else 0)
            best = np.maximum(np.array([head, *link]), np.array([*link, tail]))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int64))], [*names, out])

        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield lengths(held, before, (batch.column(k)[0].as_py(), batch.column(s)[0].as_py()))
                before = (held.column(k)[held.num_rows - 1].as_py(), held.column(s)[held.num_rows - 1].as_py())
            held = batch
        if held is not None:
            yield lengths(held, before, None)

    return ready.mapInArrow(work, f"{', '.join(f'{c} {t}' for c, t in ready.dtypes)}, {out} long")


def _strings(rows: DataFrame) -> DataFrame:
    """(w1, w2, doc_id, start) of the strings that another phrase can share on both sides of the trigger."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, at, parts, base = [], [], [], [], 0
            for doc, start, n, place, back, ahead, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # String j reaches place - j bytes before the trigger and SPAN - place + j from it on.
                lo, hi = max(0, place - left), min(n, right - SPAN + place + 1)
                if lo < hi:
                    part = back[::-1] + ahead
                    j = np.arange(lo, hi)
                    docs.append(np.full(hi - lo, doc)), starts.append(start + j), at.append(base + j), parts.append(part)
                    base += len(part)
            if parts:
                data, at = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(at)
                w = [pa.array(rolling(data, SPAN, k)[at].view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*w, pa.array(np.concatenate(docs).astype(np.int64)), pa.array(np.concatenate(starts).astype(np.int64))], ["w1", "w2", "doc_id", "start"])

    return rows.select("doc_id", "start", "n", "place", "back", "ahead", "left", "right").mapInArrow(work, "w1 long, w2 long, doc_id long, start long")


_AT = "cast(cast(doc_id as decimal(38,0)) * 2147483648 + start as decimal(38,0))"
_DOC = "cast(floor({0} / 2147483648) as bigint)"
_START = "cast({0} - cast(floor({0} / 2147483648) as decimal(38,0)) * 2147483648 as bigint)"


def repeats(df: DataFrame, scratch: Scratch) -> DataFrame:
    """For every document with a repeat: `spans` of repeated starts, and `doubtful` starts, which repeat unless they are `first`."""
    texts = texts_of(df)
    rows = scratch.write(_trigger_rows(texts), "triggers")
    again = scratch.write(rows.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key"), "again")
    scratch.sweep()
    keys = scratch.write(rows.join(again, "key").groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "keys")
    scratch.drop("triggers")
    scratch.sweep()
    found = scratch.write(_phrase_rows(texts.join(keys, "doc_id")), "phrases")
    scratch.sweep()
    classes = scratch.write(found.groupBy("key", "content").agg(F.min(F.expr(_AT)).alias("at"), F.first("n").alias("n")), "classes")
    several = classes.groupBy("key").agg(F.count("*").alias("phrases")).where("phrases > 1").select("key")
    dictionary = scratch.write(classes.join(several, "key").select(F.expr(_DOC.format("at")).alias("doc_id"), F.expr(_START.format("at")).alias("start"), "n"), "dictionary")
    scratch.sweep()
    wanted = dictionary.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("wanted"))
    known = scratch.write(_dictionary(texts.join(wanted, "doc_id")), "known")
    scratch.sweep()
    strings = scratch.write(_strings(_shared(_shared(known, "back", "left"), "ahead", "right")), "strings")
    scratch.drop("known")
    scratch.sweep()
    first = strings.groupBy("w1", "w2").agg(F.min(F.expr(_AT)).alias("at")).select(F.expr(_DOC.format("at")).alias("doc_id"), F.expr(_START.format("at")).alias("start"))
    first = scratch.write(first.groupBy("doc_id").agg(F.collect_list("start").alias("first")), "first")
    scratch.sweep()
    doubtful = scratch.write(strings.groupBy("doc_id").agg(F.collect_list("start").alias("doubtful")), "doubtful")
    scratch.drop("strings")
    scratch.sweep()
    whole = found.join(classes.select("key", "content", "at"), ["key", "content"]).where(F.expr(_AT) != F.col("at")).select("doc_id", F.struct("start", "n").alias("s"))
    whole = scratch.write(whole.groupBy("doc_id").agg(F.collect_list("s").alias("spans")), "whole")
    for name in ("again", "keys", "phrases", "classes", "dictionary"):
        scratch.drop(name)
    scratch.sweep()
    return whole.join(doubtful, "doc_id", "full").join(first, "doc_id", "full").select("doc_id", "spans", "doubtful", "first")


def _covered(size: int, begins: np.ndarray, counts: np.ndarray, doubtful: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The edges of the runs of bytes that lie in a repeated string: start and end in turn.

    `counts` starts from each of `begins` on are repeated, and so are the doubtful ones that are not first.
    """
    # A start of a string is less than SPAN before the end of the text.
    last = max(0, size - SPAN + 1)
    maybe = np.zeros(last, bool)
    maybe[doubtful[doubtful < last]] = True
    maybe[first[first < last]] = False
    alone = np.flatnonzero(maybe)
    begins, ends = np.minimum(np.concatenate((begins, alone)), last), np.minimum(np.concatenate((begins + counts, alone + 1)), last)
    begins, ends = begins[ends > begins], ends[ends > begins]
    if not len(begins):
        return np.empty(0, np.int64)
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order]) + SPAN - 1
    # A run ends where the next string begins behind all bytes so far.
    apart = np.flatnonzero(begins[1:] > reach[:-1])
    edges = np.empty(2 * len(apart) + 2, np.int64)
    edges[0], edges[2::2] = begins[0], begins[apart + 1]
    edges[1:-1:2], edges[-1] = reach[apart], reach[-1]
    return edges


def _rows_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the values of each row of a list column begin and end, and the values; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.concatenate(([0], ends)), column.flatten()


def remove_repeats(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (start, end in bytes) of every document."""
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix")
    found = repeats(df, scratch)
    joined = texts_of(df).join(found, "doc_id", "left").select("doc_id", "text", "spans", "doubtful", "first")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        spans_at, spans = _rows_of(batch.column(2))
        begins, counts = (spans.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n"))
        (doubtful_at, doubtful), (first_at, first) = ((at, values.to_numpy(zero_copy_only=False)) for at, values in map(_rows_of, (batch.column(3), batch.column(4))))
        for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            data = _bytes(text)
            own = slice(spans_at[i], spans_at[i + 1])
            edges = _covered(len(data), begins[own], counts[own], doubtful[doubtful_at[i] : doubtful_at[i + 1]], first[first_at[i] : first_at[i + 1]])
            runs, digest, whole = edges.reshape(-1, 2).tolist(), hashlib.sha256(), memoryview(data)
            for a, b in zip([0, *(end for _, end in runs)], [*(start for start, _ in runs), len(data)], strict=True):
                digest.update(whole[a:b])
            rows.append((doc, len(data), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return map_texts(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
