"""Language identification by word-first backoff.

A word known from training is scored by its log frequency in each language. A
word that no language knows is scored by its character n-grams, padded at both
ends: by the longest order of which any of its n-grams is known, and so on down
to single characters. A document's languages are weighed by the mean over its
words.

The tables are counted over a bounded sample of labelled rows (`SAMPLE`, those of
the smallest hashed id) outside the held-out fold, and hold the `ENTRIES` most
frequent words and n-grams, so their size has a bound whatever the texts. Null text and text without a
letter are `und` with score 0; ties go to the language that sorts first; repeated
rows are predicted each; without any labelled row everything is `und`.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.llm.common import map_texts, texts_of
from textward.llm.quality import held_out
from textward.session import ship

SAMPLE, ENTRIES = 6_000, 400_000
#: Orders of n-grams, longest first, and how often a word or n-gram must occur.
ORDERS, LEAST = (4, 3, 2, 1), 2
#: Words that count towards certainty, and words a worker remembers.
EVIDENCE, REMEMBERED = 40, 40_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")
_SEGMENT = 1 << 20


def words_of(text: str) -> Counter:
    """Lower-case runs of letters, counted segment by segment."""
    out: Counter = Counter()
    start = 0
    while start < len(text):
        stop = start + _SEGMENT
        if stop < len(text):
            while stop < len(text) and text[stop].isalpha():
                stop += 1
        out.update(_LETTERS.findall(text[start:stop].lower()))
        start = stop
    return out


def grams(word: str, order: int) -> list[str]:
    padded = f"^{word}$" if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class Backoff:
    """Log frequencies by word and by n-gram, and the backoff between them."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        """`counts`: (language, order or 0 for words, word or n-gram, count)."""
        self.languages = sorted({c[0] for c in counts})
        at = {name: k for k, name in enumerate(self.languages)}
        totals = defaultdict(lambda: [0.0] * len(self.languages))
        found: dict[int, dict[str, list[float]]] = defaultdict(dict)
        for language, order, key, n in counts:
            found[order].setdefault(key, [0.0] * len(self.languages))[at[language]] += n
            totals[order][at[language]] += n
        # Rows lie in one array, as lists of numbers would take several times the memory.
        self.rows = array("d")
        self.tables: dict[int, dict[str, int]] = {}
        for order, table in found.items():
            places = self.tables[order] = {}
            for key, row in table.items():
                places[key] = len(self.rows)
                self.rows.extend(math.log((n + 0.5) / (t + 0.5 * len(table))) for n, t in zip(row, totals[order], strict=True))
        self.seen: dict[str, Sequence[float] | None] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}}

    def word(self, word: str) -> Sequence[float] | None:
        """Scores of a word by language, or None if not even its characters are known."""
        width, flat = len(self.languages), self.rows
        if (at := self.tables.get(0, {}).get(word)) is not None:
            return flat[at : at + width]
        if word in self.seen:
            return self.seen[word]
        out = None
        for order in ORDERS:
            table = self.tables.get(order, {})
            rows = [flat[at : at + width] for g in grams(word, order) if (at := table.get(g)) is not None]
            if rows:
                out = [sum(c) / len(rows) for c in zip(*rows, strict=True)]
                break
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        if len(word) <= 64:
            self.seen[word] = out
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else None
        if not found or not self.languages:
            return UNKNOWN, 0.0
        sums, n = [0.0] * len(self.languages), 0
        for word, times in found.items():
            if (row := self.word(word)) is not None:
                n += times
                for k, x in enumerate(row):
                    sums[k] += times * x
        if not n:
            return self.languages[0], 1 / len(self.languages)
        weight = min(n, EVIDENCE) / n
        best = max(range(len(sums)), key=lambda k: (sums[k], -k))
        return self.languages[best], 1 / sum(math.exp(max(-700.0, weight * (x - sums[best]))) for x in sums)


def learn(df: DataFrame) -> Backoff:
    """Count words and n-grams of at most `SAMPLE` labelled documents outside the held-out fold."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out())
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[lang].update(words_of(text or ""))
            for lang, seen in words.items():
                parts: dict[int, Counter] = {0: seen, **{order: Counter() for order in ORDERS}}
                for word, n in seen.items():
                    for order in ORDERS:
                        for g in grams(word, order):
                            parts[order][g] += n
                for order, table in parts.items():
                    if table:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table)), pa.array([order] * len(table), pa.int32()), pa.array(list(table)), pa.array(list(table.values()), pa.int64())], ["lang", "n", "key", "times"])

    counts = sample.mapInArrow(count, "lang string, n int, key string, times long").groupBy("lang", "n", "key").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST)
    counts = counts.orderBy(F.desc("times"), "lang", "n", "key").limit(ENTRIES)
    # Bounded by that number; sorted, so that the same tables give the same model.
    return Backoff(sorted(tuple(r) for r in counts.toPandas().itertuples(index=False, name=None)))


def predict(df: DataFrame, model: Backoff) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""

    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample; a worker loads it once

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = held.value
        found = [model.predict(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = map_texts(texts_of(df), work, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def annotate(df: DataFrame, model: Backoff, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """The same rows and columns with `pred` and `score`, which replace columns of these names, in one narrow pass."""
    held = df.sparkSession.sparkContext.broadcast(model)
    ready = df.select(*(F.col(c) for c in df.columns if c.lower() not in (pred.lower(), score.lower()))).withColumn("text", F.col("text").cast("string"))
    names = [*ready.columns, pred, score]
    at = names.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [held.value.predict(t) for t in batch.column(at).to_pylist()]
        new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    schema = T.StructType([*ready.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return map_texts(ready, work, schema)
