"""Progress of a stream as rows that a caller can show."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Progress:
    query: str
    batch: int
    rows: int
    rows_per_second: float
    done: bool


class ProgressListener(StreamingQueryListener):
    """Hands each step of every query of the session to `emit`; add it with spark.streams.addListener."""

    def __init__(self, emit: Callable[[Progress], None]):
        self.emit = emit

    def onQueryStarted(self, event) -> None:
        self.emit(Progress(event.name or str(event.id), -1, 0, 0.0, False))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.emit(Progress(p.name or str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0), False))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.emit(Progress(str(event.id), -1, 0, 0.0, True))
