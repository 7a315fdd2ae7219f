"""Runs that end early: on request, or when their time is over."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession


class Stoppable:
    """Spark jobs that this thread starts inside the block are cancelled once stop() is called or `seconds` are over.

    The cancelled job throws where it was started. After done() nothing is cancelled any more.
    """

    def __init__(self, spark: SparkSession, seconds: float | None = None):
        self._sc, self._tag = spark.sparkContext, f"lumenquarry-{uuid.uuid4().hex}"
        self._until = None if seconds is None else time.monotonic() + seconds
        self._stop, self._done = threading.Event(), threading.Event()
        self._watcher = threading.Thread(target=self._watch, daemon=True)

    @property
    def stopped(self) -> bool:
        return self._stop.is_set()

    def _watch(self) -> None:
        while not self._done.wait(0.05):
            if self._until is not None and time.monotonic() >= self._until:
                self._stop.set()
            if self._stop.is_set():  # again and again: the next job may not have begun yet
                self._sc.cancelJobsWithTag(self._tag)

    def stop(self) -> None:
        self._stop.set()

    def done(self) -> None:
        self._done.set()
        self._watcher.join()

    def __enter__(self) -> Stoppable:
        self._sc.addJobTag(self._tag)
        self._watcher.start()
        return self

    def __exit__(self, *_) -> None:
        self.done()
        self._sc.removeJobTag(self._tag)
