"""Which frames of a screen become captures: focus changes, intervals, and no look-alikes.

Whether a frame is captured depends on what happened to those before it, so the
frames of a stream are taken one after another in the order of time, by the
same ``Decider`` over a table (``captured_frames``) and over a stream
(``streamed_frames``). A stream keeps frames in its state until the watermark
has passed them, so those that arrive out of order, but within the delay, are
taken in order all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import pending_insert
from ..sources.snapshots import Snapshots, Stale

HISTORY, LEAST_BITS, INTERVAL_MS = 3, 10, 10_000
FRAME = "stream long, id long, created_at timestamp, at_ms long, window string, excluded boolean, hash array<long>, image_hash string"
CAPTURE = "stream long, id long, at_ms long, reason string, image_hash string"


def redundant(now: list[int], kept: list[list[int]], least: int = LEAST_BITS) -> bool:
    """Whether a hash is within ``least`` bits of any of ``kept``."""
    return any(sum(((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() for a, b in zip(now, k, strict=True)) < least for k in kept)


def suppress_redundant(frames: DataFrame, stream: str, order: list[str], hash_col: str, history: int = HISTORY, least: int = LEAST_BITS) -> DataFrame:
    """The frames of each stream that differ from the last ``history`` kept ones.

    Whether a frame stays depends on which ones before it stayed, so rows are
    read in order. Streams are dealt to partitions and sorted there; a task
    holds the last hashes of one stream at a time and never a whole stream.
    """
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, []
        for b in batches:
            stay = []
            for s, h in zip(b[stream], b[hash_col], strict=True):
                if s != current:
                    current, kept = s, []
                h = [int(x) for x in h]
                keep = not redundant(h, kept, least)
                if keep:
                    kept = [*kept, h][-history:]
                stay.append(keep)
            yield b[stay]

    dealt = frames.repartition(n, stream).sortWithinPartitions(stream, *order)
    return dealt.mapInPandas(run, frames.schema)


class Decider:
    """The loop's memory of one stream: the window before, the time of the last look, and the hashes kept."""

    def __init__(self, window: str | None = None, looked: int | None = None, kept: list[list[int]] | None = None, interval_ms: int = INTERVAL_MS):
        self.window, self.looked, self.kept, self.interval_ms = window, looked, kept or [], interval_ms

    def take(self, at: int, window: str | None, excluded: bool | None, hash_: list[int]) -> str | None:
        """Why the frame is captured: ``focus`` or ``interval``; None if it is not.

        An excluded window only becomes the one before. A look that finds a
        frame like one of the last kept ones starts the interval anew.
        """
        before, self.window = self.window, window
        if excluded:
            return None
        reason = "focus" if window != before else "interval" if self.looked is None or at - self.looked >= self.interval_ms else None
        if reason is None:
            return None
        self.looked = at
        h = [int(x) for x in hash_]
        if redundant(h, self.kept):
            return None
        self.kept = [*self.kept, h][-HISTORY:]
        return reason


def captured_frames(frames: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """(stream, id, at_ms, reason, image_hash) of the frames (``FRAME``) that are captured, each stream in the order of (at_ms, id)."""
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, loop = None, Decider()
        for b in batches:
            reasons = []
            for r in b.itertuples(index=False):
                if r.stream != current:
                    current, loop = r.stream, Decider(interval_ms=interval_ms)
                reasons.append(loop.take(r.at_ms, r.window, r.excluded, r.hash))
            b = b.assign(reason=reasons)
            yield b[b["reason"].notna()][["stream", "id", "at_ms", "reason", "image_hash"]]

    dealt = frames.drop("created_at").repartition(n, "stream").sortWithinPartitions("stream", "at_ms", "id")
    return dealt.mapInPandas(run, CAPTURE)


class CaptureLoop(StatefulProcessor):
    """Holds a stream's frames until the watermark passes them, then takes them in order."""

    def __init__(self, interval_ms: int = INTERVAL_MS):
        self.interval_ms = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms long, id long", "window string, excluded boolean, hash array<long>, image_hash string")
        self.before = handle.getValueState("before", "window string, looked long")
        self.kept = handle.getListState("kept", "hash array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            for r in b.itertuples(index=False):
                self.waiting.updateValue((int(r.at_ms), int(r.id)), (r.window, bool(r.excluded), [int(x) for x in r.hash], r.image_hash))
                self.handle.registerTimer(int(r.at_ms))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer of a batch takes all that the watermark has passed; the others find nothing.
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] <= passed)
        if not ready:
            return
        window, looked = self.before.get() if self.before.exists() else (None, None)
        loop = Decider(window, looked, [list(h[0]) for h in self.kept.get()], self.interval_ms)
        out = []
        for (at, i), (name, excluded, hash_, image) in ready:
            reason = loop.take(at, name, excluded, list(hash_))
            if reason:
                out.append((key[0], i, at, reason, image))
            self.waiting.removeKey((at, i))
        self.before.update((loop.window, loop.looked))
        if loop.kept:
            self.kept.put([(h,) for h in loop.kept])
        if out:
            yield pd.DataFrame(out, columns=["stream", "id", "at_ms", "reason", "image_hash"])

    def close(self) -> None:
        pass


def streamed_frames(frames: DataFrame, delay: str = "1 minute", interval_ms: int = INTERVAL_MS) -> DataFrame:
    """The captures of a stream of frames (``FRAME``); what comes more than ``delay`` late is dropped.

    A frame is decided when the watermark passes it. The session needs the
    RocksDB state store. The state of a stream is the frames of the last
    ``delay`` and three hashes.
    """
    keyed = frames.withWatermark("created_at", delay).groupBy("stream")
    return keyed.transformWithStateInPandas(CaptureLoop(interval_ms), CAPTURE, "append", "eventTime")


def store_captures(store: Snapshots, captures: DataFrame, batch: int) -> None:
    """Commit a micro-batch of captures: pending rows and duplicates of live ones, and pending ids to the queue, once a batch.

    The tables of the store are ``captures`` (id, stream, at_ms, image_hash,
    status, duplicate_of, is_deleted) and ``queue`` (id, queued_ms).
    """
    seen = "batches/captures"
    if store.guard(seen) > batch:
        return
    base = store.read()
    have = store.table("captures", base)
    if have is None:
        have = captures.sparkSession.createDataFrame([], "id long, image_hash string, is_deleted boolean")
    rows = captures.select("id", "stream", "at_ms", "image_hash")
    # A duplicate is a row of its own that points at the live one; only pending and committed ones have duplicates.
    own = have.filter("status <> 'duplicate'") if "status" in have.columns else have
    judged = rows.join(pending_insert(own, rows), "id").withColumn("is_deleted", F.lit(False))
    staged = store.stage(judged)
    queue = store.stage(judged.filter("status = 'pending'").select("id", F.col("at_ms").alias("queued_ms")))
    try:
        store.commit(add={"captures": staged, "queue": queue}, expect={seen: batch}, guards={seen: batch + 1})
    except Stale:
        return


def run_capture_loop(frames: DataFrame, store: Snapshots, checkpoint: str, delay: str = "1 minute", interval_ms: int = INTERVAL_MS) -> None:
    """Frames to captures to pending rows and their queue, all that there is, exactly once."""
    stream = streamed_frames(frames, delay, interval_ms).writeStream.outputMode("append")
    stream = stream.foreachBatch(lambda rows, batch: store_captures(store, rows.persist(), batch))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def frame_rows(frames: DataFrame, at: Column) -> DataFrame:
    """``frames`` with the columns of ``FRAME``, ``created_at`` and ``at_ms`` of the time ``at``."""
    return frames.withColumns({"created_at": at, "at_ms": F.unix_millis(at)}).select("stream", "id", "created_at", "at_ms", "window", "excluded", "hash", "image_hash")
