"""Counts of a text that the quality operators share, one pass over the words of each text."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textward.llm.common import map_texts, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile(r"[0-9]+")

#: Counts in their order; all are whole numbers.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_bars", "n_bangs", "n_distinct", "n_top", "n_same_next", "n_ends", "n_symbol_words", "n_long_words", "n_short_words")


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of `NAMES`; null counts as empty."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x and WORD.search(x)]
    seen = Counter(words)
    index = dict(zip(seen, range(len(seen)), strict=True))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    often = np.fromiter(seen.values(), np.int64, len(seen))
    sizes = np.fromiter(map(len, seen), np.int64, len(seen))
    return (
        n,
        int(sizes @ often),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(ids, len(seen)),
        len(lines),
        len(text),
        sum(map(len, _UPPER.findall(text))),
        sum(map(len, _DIGIT.findall(text))),
        text.count("|"),
        text.count("!!"),
        len(seen),
        int(often.max()) if n else 0,
        int((ids[1:] == ids[:-1]).sum()),
        text.count(".") + text.count("!") + text.count("?"),
        sum(seen[w] for w in seen if w[-1] in SYMBOLS),
        int(often[sizes >= 16].sum()),
        int(often[sizes <= 3].sum()),
    )


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that are found twice or more in the text, the first included."""
    if len(ids) < 4 or distinct == len(ids):
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:  # keeps the products within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(windows) + k] |= hit
    return int(covered.sum())


def table_of(df: DataFrame) -> DataFrame:
    """doc_id and the counts of every text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [counts(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", *NAMES])

    return map_texts(texts_of(df), work, "doc_id long, " + ", ".join(f"{c} long" for c in NAMES))
