"""Progress of streams, throttled."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Throttle:
    """Passes on a value at most once in a period, and the last one always."""

    def __init__(self, emit: Callable[[dict], None], period: float = 0.1, clock: Callable[[], float] = time.monotonic):
        self.emit, self.period, self.clock = emit, period, clock
        self.due, self.held = -1e9, None

    def put(self, value: dict) -> None:
        now = self.clock()
        if now >= self.due:
            self.due, self.held = now + self.period, None
            self.emit(value)
        else:
            self.held = value

    def close(self) -> None:
        if self.held is not None:
            self.emit(self.held)
            self.held = None


class ProgressListener(StreamingQueryListener):
    """Tells how many rows each batch has taken; register it with spark.streams.addListener()."""

    def __init__(self, emit: Callable[[dict], None], period: float = 0.1):
        self.throttle = Throttle(emit, period)

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.throttle.put({"name": p.name, "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.throttle.close()
