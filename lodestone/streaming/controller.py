"""A stateful stream of keystrokes: debounce, immediate flush, and generations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone import config as C

OUTPUT = "session string, generation long, query string"
_STATE = "generation long, pending string"


def step(events: list[tuple[str, str]], generation: int, pending: str) -> tuple[list[tuple[int, str]], int, str]:
    """What some events of one session, in order, emit at once; and the state after them.

    Events are ('type', text) and ('flush', ''). Typing starts a new generation, which makes all older ones stale. A blank
    query clears what is pending. A flush emits what is pending now; a second one finds nothing.
    """
    out = []
    for kind, text in events:
        if kind == "flush":
            if pending:
                out.append((generation, pending))
                pending = ""
        else:
            generation += 1
            pending = text.strip()
    return out, generation, pending


def controlled(events: DataFrame, quiet_ms: int = C.QUERY_QUIET_MS) -> DataFrame:
    """Emits each session's query after a quiet time, or at once on a flush. events: session, kind, query, seq, streaming."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, pending = state.get if state.exists else (0, "")
        if state.hasTimedOut:
            out, pending = ([(generation, pending)] if pending else []), ""
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            out, generation, pending = step(list(zip(rows["kind"], rows["query"], strict=True)), generation, pending)
        state.update((generation, pending))
        if pending:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({"session": [key[0]] * len(out), "generation": [g for g, _ in out], "query": [q for _, q in out]})

    return events.groupBy("session").applyInPandasWithState(run, OUTPUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
