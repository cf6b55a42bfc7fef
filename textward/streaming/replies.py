"""Streamed replies: parts gather in state until the final one arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session string, message string, reply string, parts int"
_DAY_MS = 24 * 3600 * 1000


def assemble(parts: DataFrame) -> DataFrame:
    """(session, message, reply, parts) once a reply's final part has come.

    `parts` streams session, message, seq, delta, final. State older than 24 hours
    without a new part is dropped.
    """

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, texts = (list(x) for x in state.get) if state.exists else ([], [])
        final = False
        for batch in batches:
            seqs += batch["seq"].tolist()
            texts += batch["delta"].fillna("").tolist()
            final |= bool(batch["final"].any())
        if final:
            order = sorted(range(len(seqs)), key=seqs.__getitem__)
            if state.exists:
                state.remove()
            yield pd.DataFrame([(*key, "".join(texts[i] for i in order), len(texts))], columns=["session", "message", "reply", "parts"])
        else:
            state.update((seqs, texts))
            state.setTimeoutDuration(_DAY_MS)

    return parts.groupBy("session", "message").applyInPandasWithState(gather, OUT, "seqs array<long>, texts array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
