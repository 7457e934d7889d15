"""A queue of jobs by events, with retry times and expiry as timers.

The state of a job is its queue time, attempts and what it waits for. Events
are taken in the order of time once the watermark has passed them, and a timer
stands for each time at which something happens by itself: a retry that falls
due, or the end of the 30 days that an unscored job is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed values of the retry rule: seconds until the next attempt, by attempts before; then a job has failed. Days that a job is kept.
RETRY_S, KEEP_DAYS = (30, 60, 120, 300), 30
KEEP_MS = KEEP_DAYS * 86_400_000
EVENT = "subject long, what string, at timestamp, at_ms long, seq long"
STEP = "subject long, at_ms long, step string, attempts int"


class Job:
    """One job's course: ``enqueue``, ``fail`` and ``done`` come in, steps go out.

    ``due`` follows ``enqueue`` at once, and ``fail`` after its retry time;
    the fifth failure is ``failed``, and a job not done within 30 days of its
    queue time ``expired``. Only a due job can fail or be done. A job that has
    ended can be queued again; one that hasn't stays as it is.
    """

    def __init__(self, queued: int | None = None, attempts: int = 0, retry: int | None = None):
        self.queued, self.attempts, self.retry = queued, attempts, retry

    def until(self, at: int) -> list[tuple[int, str, int]]:
        """What happens by itself up to ``at``: retries and the expiry, in order."""
        out = []
        if self.queued is None:
            return out
        end = self.queued + KEEP_MS
        if self.retry is not None and self.retry <= at and self.retry < end:
            out.append((self.retry, "due", self.attempts))
            self.retry = None
        if end <= at:
            out.append((end, "expired", self.attempts))
            self.__init__()
        return out

    def take(self, at: int, what: str) -> list[tuple[int, str, int]]:
        out = self.until(at)
        if what == "enqueue" and self.queued is None:
            self.__init__(at)
            out.append((at, "due", 0))
        elif what == "done" and self.queued is not None and self.retry is None:
            out.append((at, "done", self.attempts))
            self.__init__()
        elif what == "fail" and self.queued is not None and self.retry is None:
            if self.attempts < len(RETRY_S):
                self.retry = at + 1000 * RETRY_S[self.attempts]
                self.attempts += 1
            else:
                out.append((at, "failed", self.attempts + 1))
                self.__init__()
        return out

    def timers(self) -> list[int]:
        return [] if self.queued is None else [self.queued + KEEP_MS, *([self.retry] if self.retry is not None else [])]


class JobQueue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms long, seq long", "what string")
        self.job = handle.getValueState("job", "queued long, attempts int, retry long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            for r in b.itertuples(index=False):
                self.waiting.updateValue((int(r.at_ms), int(r.seq)), (r.what,))
                self.handle.registerTimer(int(r.at_ms))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        job = Job(*self.job.get()) if self.job.exists() else Job()
        out = []
        for (at, seq), (what,) in sorted((k, v) for k, v in self.waiting.iterator() if k[0] <= passed):
            out += job.take(at, what)
            self.waiting.removeKey((at, seq))
        out += job.until(passed)
        if job.queued is None:
            self.job.clear()
        else:
            self.job.update((job.queued, job.attempts, job.retry))
            for t in job.timers():
                self.handle.registerTimer(t)
        if out:
            yield pd.DataFrame([(key[0], at, step, n) for at, step, n in out], columns=["subject", "at_ms", "step", "attempts"])

    def close(self) -> None:
        pass


def streamed_queue(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(subject, at_ms, step, attempts) of a stream of events (``EVENT``); needs the RocksDB state store.

    Events of one time are taken in the order of ``seq``. A step that happens
    by itself comes out when the watermark has passed its time.
    """
    return events.withWatermark("at", delay).groupBy("subject").transformWithStateInPandas(JobQueue(), STEP, "append", "eventTime")


def queue_steps(events: DataFrame, until_ms: int) -> DataFrame:
    """The same over a table, up to ``until_ms``: each subject's events in order, a subject at a time."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, job = None, Job()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.subject != current:
                    out += [(current, *x) for x in job.until(until_ms)]
                    current, job = r.subject, Job()
                out += [(current, *x) for x in job.take(r.at_ms, r.what)]
            yield pd.DataFrame(out, columns=["subject", "at_ms", "step", "attempts"])
        yield pd.DataFrame([(current, *x) for x in job.until(until_ms)], columns=["subject", "at_ms", "step", "attempts"])

    dealt = events.select("subject", "what", "at_ms", "seq").filter(events["at_ms"] <= until_ms)
    return dealt.repartition(n, "subject").sortWithinPartitions("subject", "at_ms", "seq").mapInPandas(run, STEP)
