"""Progress of streaming queries as events for subscribers; who comes late gets the last event at once."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


@dataclass(frozen=True)
class Event:
    """What a query has done: its run, what happened (started, progress, idle, ended, failed), and for progress its numbers."""

    run: str
    what: str
    batch: int | None = None
    rows: int | None = None
    seconds: float | None = None
    error: str | None = None


Subscriber = Callable[[Event | None], None]


class Progress(StreamingQueryListener):
    """Hands events to subscribers in their order. A subscriber that fails is left out of no later event and stops no other."""

    def __init__(self) -> None:
        self.last: Event | None = None
        self._subscribers: list[Subscriber] = []
        self._lock = threading.RLock()

    def subscribe(self, told: Subscriber) -> Callable[[], None]:
        """Call `told` with the last event now (None if there is none) and with all that follow; returns how to end that."""
        with self._lock:  # no event falls between the replay and the first of those that follow
            self._subscribers.append(told)
            told(self.last)

        def leave() -> None:
            with self._lock:
                if told in self._subscribers:
                    self._subscribers.remove(told)

        return leave

    def _emit(self, event: Event) -> None:
        with self._lock:
            self.last = event
            for told in list(self._subscribers):
                try:
                    told(event)
                except Exception:  # noqa: BLE001, S112  a subscriber's own matter
                    continue

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._emit(Event(str(event.runId), "started"))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self._emit(Event(str(p.runId), "progress", p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        self._emit(Event(str(event.runId), "idle"))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._emit(Event(str(event.runId), "failed" if event.exception else "ended", error=event.exception))


@contextmanager
def progress_events(spark: SparkSession) -> Iterator[Progress]:
    """Events of all queries of the session that run inside."""
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        yield progress
    finally:
        spark.streams.removeListener(progress)
