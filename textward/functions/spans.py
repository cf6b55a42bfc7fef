"""Spans of code points, half open, as arrays of (start, end), in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"


def none() -> Column:
    return F.array().cast(SPAN)


def merged(spans: Column) -> Column:
    """Sorted, with overlapping and touching spans joined: a span stays if it starts beyond all ends before it, and reaches to the last end before the next that stays."""
    ordered = F.array_sort(spans)

    def joined(s: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_max(F.transform(F.slice(s, 1, i), lambda x: x["end"])))
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["start"] > F.get(tops, i - 2)))
        last = lambda k: F.coalesce(F.get(heads, k + 1) - 2, F.size(s) - 1)
        return F.transform(heads, lambda i, k: F.struct(F.get(s, i - 1)["start"].alias("start"), F.get(tops, last(k)).alias("end")))

    return F.when(F.size(spans) <= 1, spans).otherwise(joined(ordered)).cast(SPAN)
