"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct shingles of five words (A-Z lower-cased). Two
permutations make all coordinates of a signature: the first places a shingle on a
circle, the second ranks the places; coordinate k is the smallest rank after a
circular shift by k. Coordinates in bands give bucket keys. Documents of equal
sets are one class; class representatives that share a key are candidates, and
links are confirmed on full sets (100 * intersection >= 75 * union).

With 32 bands of 4 a pair at the limit is missed with a chance of 5 in a million.
Null text counts as empty; without words a document has no shingle, links with
nothing and is kept. Equal texts link at any length. Repeated rows of one id are
one document; if their texts differ, it meets others by the bands of all of them and
is compared by the set whose bytes sort last, and each row has its own n_shingles.
Rows without an id cannot be named in a result and keep a null
component. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import map_texts, texts_of
from textward.llm.components import components, link
from textward.session import Scratch, ship

WORDS, BANDS, ROWS = 5, 32, 4
#: Members of a bucket that meet in a task, twice as many where it has more.
BLOCK = 512
_BASE = np.uint64(0x9E3779B97F4A7C55)
_SEGMENT = 1 << 19


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random codes of bytes (A-Z as a-z), which bytes end a word, powers of the base and of its inverse."""
    codes = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
    codes[65:91] = codes[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * _SEGMENT, _BASE))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * _SEGMENT, inverse))), dtype=np.uint64)
    return codes, space, powers, back


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of 32 bits that spreads every bit; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes, by polynomial prefix sums."""
    codes, space, powers, back = _tables()
    raw = np.frombuffer(data, np.uint8)
    out, start = [], 0
    while start < len(raw):
        stop = min(len(raw), start + _SEGMENT)
        while stop < len(raw) and not space[raw[stop]] and stop - start < 2 * _SEGMENT:
            stop += 1
        if stop < len(raw) and not space[raw[stop]]:  # a word longer than the tables
            end = stop
            while end < len(raw) and not space[raw[end]]:
                end += 1
            word = raw[start:end]
            gaps = np.flatnonzero(space[word])
            if len(gaps):
                stop = start + int(gaps[-1]) + 1
            else:
                low = bytes(word).lower()  # of bytes: A-Z only
                out.append(np.frombuffer(hashlib.blake2b(low, digest_size=8).digest(), np.uint64))
                start = end
                continue
        part = raw[start:stop]
        gap = np.concatenate(([True], space[part], [True]))
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        begins, ends = edges[::2], edges[1::2]
        if len(begins):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[part] * powers[: len(part)], dtype=np.uint64)))
            out.append(mix((sums[ends] - sums[begins]) * back[begins]))
        start = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    data = text.encode() if isinstance(text, str) else (text or b"")
    w = word_hashes(data)
    if not len(w):
        return w
    n = min(len(w), words)
    # A shorter sequence starts from another seed: it is no shingle of a longer text.
    acc = np.full(len(w) - n + 1, np.uint64(1 if n == words else 1000 + n))
    for k in range(n):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + w[k : len(w) - n + 1 + k])
    return np.unique(acc)


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """All coordinates from two permutations, one of them circularly shifted."""
    place = mix(found ^ np.uint64(0x51ED270B)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32) * np.uint32(0x01000193)
    best = np.full(size, np.uint32(2**32 - 1))
    for i in range(0, len(place), 2048):
        np.minimum(best, mix32(place[i : i + 2048, None] + shift).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    acc = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
    return acc.view(np.int64)


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, number of shingles, 128-bit digest of the set, and band keys, for every text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, high, low, bands = [], [], [], []
        for text in batch.column(1):
            found = shingles(text.as_buffer().to_pybytes() if text.is_valid else None)
            sizes.append(len(found))
            if len(found):
                a, b = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64)
                high.append(int(a)), low.append(int(b)), bands.append(band_keys(signature(found)))
            else:
                high.append(None), low.append(None), bands.append(None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return map_texts(texts_of(df), work, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def _sets(df: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t.as_buffer().to_pybytes() if t.is_valid else None).tobytes() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "found"])

    return map_texts(df, work, "id long, found binary")


def _common(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sets x and y that reach the limit."""
    ship(pairs.sparkSession)

    def work(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= 75 * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def settle_bucket(ids: np.ndarray, component: np.ndarray, found: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of a bucket's members, as far as any link does.

    Members outside the largest component are compared with all of another
    component; so every pair across components is compared.
    """
    _, group, size = np.unique(component, return_inverse=True, return_counts=True)
    lengths = np.array([len(x) for x in found])
    starts = np.cumsum(lengths) - lengths
    codes = np.unique(np.concatenate(found), return_inverse=True)[1]
    marks = np.zeros(int(codes.max()) + 1, np.int64)
    out = []
    for p in np.flatnonzero(group != size.argmax()):
        own = codes[starts[p] : starts[p] + lengths[p]]
        marks[own] = 1
        same = np.add.reduceat(marks[codes], starts)
        marks[own] = 0
        for q in np.flatnonzero((group != group[p]) & (100 * same >= 75 * (lengths + lengths[p] - same))):
            if group[q] != group[p]:
                group[group == group[q]] = group[p]
                out.append((int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))))
    return out


def _settled(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within open buckets, which go to tasks in pairs of blocks of bounded size."""
    parts = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = rows.select("key", "id", "component", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "component")
    ready = dealt.join(sets, "id").select("key", "lo", "hi", "id", "component", "found").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def work(batches):
        name, ids, component, found = None, [], [], []

        def links() -> list[tuple[int, int]]:
            return settle_bucket(np.array(ids), np.array(component), found) if len(set(component)) > 1 else []

        for batch in batches:
            out = []
            for key, lo, hi, one, c, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (key, lo, hi) != name:
                    out += links()
                    name, ids, component, found = (key, lo, hi), [], [], []
                ids.append(one), component.append(c), found.append(np.frombuffer(raw, np.uint64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["a", "b"])
        if out := links():
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["a", "b"])

    return ready.mapInArrow(work, "a long, b long").distinct()


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = texts_of(df)
    sketch = scratch.write(sketches(texts), "sketches")
    classes = scratch.write(sketch.where("doc_id is not null and h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("size")), "classes")
    keyed = classes.select("rep", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = scratch.write(keyed.join(shared, "key").select("key", F.col("rep").alias("id"), "size"), "buckets")
    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = scratch.write(_sets(texts.join(wanted, "doc_id", "left_semi")).groupBy("id").agg(F.max("found").alias("found")), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
        return _common(one.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a"))

    found = components(link(buckets, verify, scratch, lambda rows: _settled(rows, sets)), scratch, "components")
    named = classes.select("h1", "h2", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
