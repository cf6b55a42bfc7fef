"""Scorers: what answers the questions of judgments. A hosted model is one more `FunctionScorer`."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textward.operators.planning import ANSWERS, LATE
from textward.session import ship


@dataclass
class Scorer:
    """Answers the requests of a check: `answered` adds an array column of maps from question to probabilities, aligned with the requests."""

    model: str = "scorer"
    max_request_bytes: int | None = 1_048_576

    def answered(self, df: DataFrame, requests: str, out: str) -> DataFrame:
        raise NotImplementedError


@dataclass
class RuleScorer(Scorer):
    """Answers by native expressions: for each `policy.question`, or bare question, a function from the request to a probability or an array of them."""

    rules: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    model: str = "rules"

    def answered(self, df: DataFrame, requests: str, out: str) -> DataFrame:
        def answer(r: Column) -> Column:
            rows = []
            for name, rule in self.rules.items():
                value = rule(r)
                rows.append(F.struct(F.lit(name).alias("key"), value.cast("array<double>").alias("value")))
            return F.map_from_entries(F.array(*rows))

        return df.withColumn(out, F.transform(F.col(requests), answer).cast(ANSWERS))


def one(p: Column) -> Column:
    """A single probability as an answer."""
    return F.array(p.cast("double"))


@dataclass
class TableScorer(Scorer):
    """Answers from a table (key, question, probabilities): the same for all requests of a check.

    Of several answers to a question the one of the highest first probability
    counts. With a column `seconds`, answers over `deadline` are late. The table is
    aggregated by key before the join; the checks keep one row for each of theirs.
    """

    answers: DataFrame | None = None
    key: str = "id"
    model: str = "table"
    deadline: float | None = None

    def answered(self, df: DataFrame, requests: str, out: str) -> DataFrame:
        rows = self.answers
        late = F.lit(False) if self.deadline is None else F.coalesce(F.col("seconds") > self.deadline, F.lit(False))
        rows = rows.select(F.col(self.key).alias(out + "_k"), F.col("question").alias("q"), F.col("probabilities").cast("array<double>").alias("p"), late.alias("late"))
        best = rows.groupBy(out + "_k", "q").agg(F.max(F.struct(F.get("p", 0).alias("first"), "p")).alias("x"), F.max("late").alias("late"))
        entries = F.collect_list(F.struct("q", F.col("x.p").alias("p")))
        table = best.groupBy(out + "_k").agg(entries.alias("e"), F.max("late").alias("late"))
        held = F.when(F.col("late"), F.array_append(F.col("e"), F.struct(F.lit(LATE).alias("q"), F.array(F.lit(1.0)).alias("p")))).otherwise(F.col("e"))
        table = table.select(out + "_k", F.map_from_entries(held).alias(out + "_m"))
        joined = df.join(table, F.col(self.key) == F.col(out + "_k"), "left")
        return joined.withColumn(out, F.transform(F.col(requests), lambda r: F.col(out + "_m")).cast(ANSWERS)).drop(out + "_k", out + "_m")


@dataclass
class FunctionScorer(Scorer):
    """Answers by a Python function from a request (a dict of text, span, state and grp) to a mapping, in Arrow batches; an error is no answer."""

    function: Callable[[dict], Mapping[str, list[float]]] | None = None
    model: str = "function"

    def answered(self, df: DataFrame, requests: str, out: str) -> DataFrame:
        ship(df.sparkSession)
        kind, function = to_arrow_type(T._parse_datatype_string(ANSWERS)), self.function

        def ask(request: dict) -> list | None:
            try:
                return [(k, [float(x) for x in v]) for k, v in function(request).items()]
            except Exception:  # whatever a model's client raises, the request has failed
                return None

        @F.arrow_udf(ANSWERS)
        def run(rows: pa.Array) -> pa.Array:
            return pa.array([None if r is None else [ask(x) for x in r] for r in rows.to_pylist()], kind)

        return df.withColumn(out, run(F.col(requests)))


def as_scorer(model: object) -> Scorer:
    """A scorer from what a user has: a scorer, a function, or rules by question."""
    if isinstance(model, Scorer):
        return model
    if callable(model):
        return FunctionScorer(function=model)
    if isinstance(model, Mapping):
        return RuleScorer(rules=model)
    raise TypeError("a scorer, a function or rules")
