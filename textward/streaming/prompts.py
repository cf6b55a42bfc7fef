"""Session prompts in a stream: the last allowed input of a session is what its later calls and replies are judged against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textward.sources.hooks import keeps_state

OUT = "session string, seq long, stage string, text string, prompt string, refused boolean"


def with_prompt(checked: DataFrame) -> DataFrame:
    """(session, seq, stage, text, prompt, refused) of a stream of session, seq, stage, text, ok.

    `prompt` is the last allowed input before an event, in the order of seq within
    a batch; calls and replies without one are refused. Sessions whose id is not fit
    to keep state for are left out.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prompt = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            out.append((key[0], row.seq, row.stage, row.text, prompt, bool(row.stage in ("tool_call", "output") and prompt is None)))
            if row.stage == "input" and row.ok:
                prompt = row.text
        if prompt is not None:
            state.update((prompt,))
        yield pd.DataFrame(out, columns=["session", "seq", "stage", "text", "prompt", "refused"])

    fit = checked.where(keeps_state(checked["session"]))
    return fit.groupBy("session").applyInPandasWithState(follow, OUT, "prompt string", "append", GroupStateTimeout.NoTimeout)
