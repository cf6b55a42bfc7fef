"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and logarithms of a text's counts, binned at quantiles.
Boosting goes round the features in turn; each step fits a tree of few leaves to
one feature's histogram of gradients and adds it to that feature's lookup table.
Then the pairs whose joint histogram explains most of what is left get tables of
their own, boosted alike with trees that split one feature and then the other.
A score is the sum of looked-up values, so scoring is a few vectorised additions.

Labels are learned from a bounded sample (`SAMPLE` rows, those of the smallest
hashed id); everything else covers every document. Null text counts as empty and
gets a score; repeated rows are scored each; repeated labels of an id count once
(the lowest). Without labels every score is 0.5. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.llm import features
from textward.llm.common import map_texts, texts_of

#: Most labelled rows that are learned from.
SAMPLE = 20_000
BINS, ROUNDS, RATE, LEAVES = 32, 150, 0.15, 4
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 40


def held_out(column: str = "doc_id") -> Column:
    """Whether a row is in the fold that nothing is learned from."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


def vectors(counts: np.ndarray) -> np.ndarray:
    """Features of rows of `features.NAMES`."""
    c = {n: counts[:, k].astype(np.float64) for k, n in enumerate(features.NAMES)}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / chars,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)),
            c["n_upper"] / chars,
            c["n_digits"] / chars,
            c["n_bars"] / words,
            c["n_bangs"] / words,
            c["n_distinct"] / words,
            c["n_top"] / words,
            c["n_same_next"] / words,
            c["n_ends"] / words,
            c["n_symbol_words"] / words,
            c["n_long_words"] / words,
            c["n_short_words"] / words,
        ],
        axis=1,
    )


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float = 1.0) -> tuple[np.ndarray, float]:
    """Values of a tree over ordered bins, by Newton steps, and the gain of its splits."""
    gain_of = lambda a, b: a * a / (b + least)
    parts, total = [(0, len(g))], 0.0
    while len(parts) < leaves:
        best = None
        for k, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
            gain = gain_of(left_g, left_h) + gain_of(all_g - left_g, all_h - left_h) - gain_of(all_g, all_h)
            at = int(gain.argmax())
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
                best = (float(gain[at]), k, lo + at + 1)
        if best is None:
            break
        lo, hi = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(lo, best[2]), (best[2], hi)]
        total += best[0]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + least)
    return out, total


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that splits one feature once and the other once on either side, the better way round."""
    best = (np.zeros_like(g), -1.0)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, a.shape[0]):
            out, gain = np.zeros_like(a), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                sum_g, sum_h = a[rows].sum(0), b[rows].sum(0)
                value, _ = _tree(sum_g, sum_h, 2)
                out[rows] = value
                gain += float(value @ sum_g)
            if gain > best[1]:
                best = (out.T if flip else out, gain)
    return best


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, k = x.shape
        share = (y.sum() + 0.5) / (n + 1) if n else 0.5
        model = AdditiveModel(float(np.log(share / (1 - share))), [_edges(x[:, j], BINS) for j in range(k)], [], [], [_edges(x[:, j], PAIR_BINS) for j in range(k)], [])
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        if not n:
            return model
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
        raw = np.full(n, model.intercept)

        def gradients() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-raw))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j in range(k):
                g, h = gradients()
                m = len(model.tables[j])
                step, _ = _tree(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m), LEAVES)
                model.tables[j] += RATE * step
                raw += RATE * step[bins[j]]
        few = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
        g, h = gradients()
        gains = []
        for a in range(k):
            for b in range(a + 1, k):
                shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
                flat = few[a] * shape[1] + few[b]
                _, gain = _pair_tree(np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape))
                gains.append((-gain, a, b, flat, shape))
        chosen = sorted(gains, key=lambda z: z[:3])[:PAIRS]
        model.pairs = [(a, b) for _, a, b, _, _ in chosen]
        model.pair_tables = [np.zeros(shape) for *_, shape in chosen]
        for _ in range(PAIR_ROUNDS):
            for i, (_, _, _, flat, shape) in enumerate(chosen):
                g, h = gradients()
                step, _ = _pair_tree(np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape))
                model.pair_tables[i] += RATE * step
                raw += RATE * step.ravel()[flat]
        return model

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            raw += t[np.searchsorted(e, x[:, j], side="right")]
        if self.pairs:
            few = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                raw += t[few[a], few[b]]
        return 1 / (1 + np.exp(-raw))


def learn(df: DataFrame, labels: DataFrame) -> AdditiveModel:
    """Fit on at most `SAMPLE` labelled documents outside the held-out fold."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    texts = texts_of(df).join(F.broadcast(chosen), "doc_id", "left_semi")
    found = features.table_of(texts).groupBy("doc_id").agg(*(F.min(c).alias(c) for c in features.NAMES))
    rows = found.join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id")  # at most SAMPLE rows of a few numbers
    return AdditiveModel.fit(vectors(rows[list(features.NAMES)].to_numpy(np.int64).reshape(-1, len(features.NAMES))), rows["quality"].to_numpy(np.float64))


def score(df: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.array([features.counts(t) for t in batch.column(1).to_pylist()], np.int64)
        p = model.scores(vectors(counts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.3).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_texts(texts_of(df), work, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
