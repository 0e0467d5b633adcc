"""Keeping streaming queries and periodic jobs running: restarts with growing pauses, runs with a time limit."""

from __future__ import annotations

import itertools
import logging
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark import InheritableThread
from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)

# Restarts in a row, the base and the longest of the pauses between them, a job's period and time limit, in seconds.
MOST_RESTARTS, PAUSE_BASE, LONGEST_PAUSE = 5, 2.0, 60.0
PERIOD, TIME_LIMIT = 300.0, 300.0


def kept_running(start: Callable[[], StreamingQuery], most: int = MOST_RESTARTS, base: float = PAUSE_BASE, longest: float = LONGEST_PAUSE, pause: Callable[[float], None] = time.sleep) -> int:
    """Starts a query, and after a failure starts it again from its checkpoint; returns the number of restarts when it ends by itself.

    The n-th failure in a row is followed by a pause of base ** n seconds, `longest` at
    most; the one after `most` restarts in a row is raised. A query that has taken rows in before it failed starts the count anew.
    """
    failures = restarts = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return restarts
        except StreamingQueryException:
            if any(progress["numInputRows"] for progress in query.recentProgress):
                failures = 0
            failures += 1
            if failures > most:
                raise
            log.warning("query %s failed, restart %d of %d", query.name or query.id, failures, most)
            pause(min(base**failures, longest))
            restarts += 1


def every(spark: SparkSession, job: Callable[[], object], period: float = PERIOD, limit: float = TIME_LIMIT, runs: int | None = None) -> Iterator[str]:
    """Runs job() every `period` seconds, `runs` times or for ever, and yields each run's outcome: ok, failed or stopped.

    A run that takes longer than `limit` seconds has its Spark jobs cancelled. A failure doesn't
    end the series; a run that takes longer than the period delays the next.
    """
    for _ in range(runs) if runs is not None else itertools.count():
        began, group, failure = time.monotonic(), f"every-{uuid.uuid4().hex}", []

        def run(group=group, failure=failure):
            spark.sparkContext.setJobGroup(group, "periodic job", interruptOnCancel=True)
            try:
                job()
            except Exception as error:  # reported as the run's outcome
                failure.append(error)

        thread = InheritableThread(target=run, daemon=True)
        thread.start()
        thread.join(limit)
        stopped = thread.is_alive()
        if stopped:
            spark.sparkContext.cancelJobGroup(group)
            thread.join(limit)
        if failure:
            log.warning("periodic job %s: %s", "stopped" if stopped else "failed", failure[0])
        yield "stopped" if stopped else "failed" if failure else "ok"
        time.sleep(max(0.0, began + period - time.monotonic()))
