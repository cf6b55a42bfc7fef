"""Quality rules by weak supervision.

Each rule votes good or bad, or abstains. Votes of all documents are counted by
pattern (there are few patterns, whatever the number of documents); on these
counts expectation-maximisation estimates each rule's accuracies and the share of
good documents, without labels. A document's verdict is the posterior
probability of being good, given its votes.

Null text counts as empty. Repeated rows count and are judged each. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.llm import features
from textward.session import Scratch, ship

#: Posterior from which a document is kept, and pseudo-counts of each rule's accuracy.
KEEP, PRIOR = 0.5, 20.0


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


#: Rules: (name, good where, bad where); between the two a rule abstains.
RULES: list[tuple[str, Callable[[], Column], Callable[[], Column]]] = [
    ("length", lambda: F.col("n_words") >= 100, lambda: F.col("n_words") < 50),
    ("symbols", lambda: _share("n_symbols", "n_chars") < 0.005, lambda: _share("n_symbols", "n_chars") > 0.04),
    ("symbol_words", lambda: _share("n_symbol_words", "n_words") < 0.02, lambda: _share("n_symbol_words", "n_words") > 0.2),
    ("capitals", lambda: _share("n_upper", "n_chars") < 0.06, lambda: _share("n_upper", "n_chars") > 0.25),
    ("bangs", lambda: F.col("n_bangs") == 0, lambda: _share("n_bangs", "n_words") > 0.1),
    ("repeats", lambda: _share("n_repeat_words", "n_words") < 0.15, lambda: _share("n_repeat_words", "n_words") > 0.5),
    ("same_next", lambda: _share("n_same_next", "n_words") < 0.02, lambda: _share("n_same_next", "n_words") > 0.2),
    ("dup_lines", lambda: (F.col("n_lines") >= 2) & (F.col("n_dup_lines") == 0), lambda: _share("n_dup_lines", "n_lines") > 0.3),
    ("word_size", lambda: _share("word_chars", "n_words").between(3.0, 8.5), lambda: ~_share("word_chars", "n_words").between(2.5, 12.0)),
    ("short_words", lambda: _share("n_short_words", "n_words").between(0.12, 0.7), lambda: ~_share("n_short_words", "n_words").between(0.03, 0.9)),
]

BASE_FAILED = lambda: (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> Column:
    """One digit for each rule, as a string: 2 good, 0 bad, 1 abstains."""
    return F.concat(*(F.when(bad(), F.lit("0")).when(good(), F.lit("2")).otherwise(F.lit("1")) for _, good, bad in RULES))


def fit(patterns: list[str], weights: list[int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over the counted patterns.

    Returns each pattern's posterior of good; each rule's log likelihood by class
    and vote; the share of good. It starts from the majority of the votes, so
    that "good" keeps its meaning.
    """
    v = np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(RULES))
    w = np.asarray(weights, np.float64)
    score = (v == 2).sum(1) - 2.0 * (v == 0).sum(1)
    good = 1 / (1 + np.exp(-(score - 1.0)))
    onehot = (v[:, :, None] == np.arange(3)).astype(np.float64)
    shape = np.array([[0.45, 0.35, 0.2], [0.05, 0.2, 0.75]])  # by class (bad, good) and vote
    share = 0.5
    logs = np.zeros((2, len(RULES), 3))
    for _ in range(rounds):
        share = float(np.clip((w @ good + PRIOR) / (w.sum() + 2 * PRIOR), 1e-3, 1 - 1e-3))
        for c, p in ((0, 1 - good), (1, good)):
            n = np.einsum("p,prv->rv", w * p, onehot) + PRIOR * shape[c]
            logs[c] = np.log(n / n.sum(1, keepdims=True))
        odds = np.log(share / (1 - share)) + np.einsum("prv,rv->p", onehot, logs[1] - logs[0])
        good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return good, logs, share


def judge(df: DataFrame) -> DataFrame:
    """Counts, base rules, votes, posterior and verdict of every document.

    The counts are written once; the votes' counts and the verdicts read them.
    """
    spark = df.sparkSession
    ship(spark)
    held = Scratch(spark, "rules").write(features.table_of(df), "counts").withColumn("votes", votes())
    found = held.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** len(RULES) rows, by construction
    good, _, _ = fit([r["votes"] for r in found], [r["count"] for r in found])
    table = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(found, good, strict=True)], "votes string, quality double")
    out = held.join(F.broadcast(table), "votes", "left")
    return out.select(
        "doc_id",
        *(c for c in features.NAMES),
        BASE_FAILED().alias("base_failed"),
        (~BASE_FAILED() & (F.col("quality") >= KEEP)).alias("kept"),
        "votes",
        "quality",
    )
