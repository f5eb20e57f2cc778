"""Change events: debounce, coalescing and reconciliation, for batches and for streams alike."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType


def debounce(events: DataFrame, gap: str, key: str = "key", ts: str = "ts", order: str = "event_id", delay: str = "1 day") -> DataFrame:
    """Of events of a key that follow each other within the gap only the last one: key, session_start, session_end, n, last_event.

    In a stream, a session is told once the watermark has passed its end. State is one row per open session.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, delay) if events.isStreaming else rows
    each = rows.groupBy(F.col(key), F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.max(F.struct(ts, order)).alias("_last"))
    return each.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n", F.col(f"_last.{order}").alias("last_event"))


WINDOWS = "scope string, start long, what string, n long"


def coalesce(events: DataFrame, width: str, keys: list[str], scope: str, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Counts by keys of the events of each window: (scope, window_start, keys, n). The first event of a scope after an idle time opens a window, which ends `width` later; the next
    event, be it at that very time, opens the next one.

    In a batch, an event at least `width` after the one before it opens a window whatever was before, so that scopes are cut there and each stretch is folded in order, row by row. A stream
    keeps the counts of what isn't told yet; a timer tells a window once the watermark has passed its end. Rows without a time or scope are left out.
    """
    row = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull() & F.col(scope).isNotNull())
    micros = int(events.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {width}) AS w").first()["w"])
    kinds = row.select(F.col(scope).alias("scope"), *keys).schema
    parts = [F.col(scope).cast("string").alias("scope"), F.unix_micros(ts).alias("at"), F.to_json(F.struct(*keys)).alias("what")]
    if events.isStreaming:
        told = row.withWatermark(ts, delay).select(*parts, ts).groupBy("scope").transformWithStateInPandas(Coalescer(micros), WINDOWS, "Append", "EventTime")
    else:
        at = row.select(*parts)
        gap = F.col("at") - F.lag("at").over(Window.partitionBy("scope").orderBy("at"))
        stretch = F.sum((gap >= micros).cast("long")).over(Window.partitionBy("scope").orderBy("at"))
        dealt = at.withColumn("stretch", F.coalesce(stretch, F.lit(0))).repartition("scope", "stretch").sortWithinPartitions("scope", "stretch", "at")
        told = dealt.mapInArrow(lambda b: _folded(b, micros), WINDOWS)
    counted = F.from_json("what", StructType(kinds.fields[1:]))
    return told.select(F.col("scope").cast(kinds["scope"].dataType).alias(scope), F.timestamp_micros("start").alias("window_start"), counted.alias("_k"), "n").select(scope, "window_start", "_k.*", "n")


def _folded(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of rows (scope, at, what, stretch) in order; what is held is the open window."""
    own, start, counts = None, 0, Counter()
    for batch in batches:
        out = []
        for scope, at, what, stretch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != (scope, stretch) or at >= start + width:
                out += [(own[0], start, w, n) for w, n in counts.items()]
                own, start, counts = (scope, stretch), at, Counter()
            counts[what] += 1
        yield _windows(out)
    yield _windows([(own[0], start, w, n) for w, n in counts.items()])


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["scope", "start", "what", "n"])


class Coalescer(StatefulProcessor):
    """State of a scope: how often what came when, of all that isn't told; and a timer at the end of the window that the earliest of it opens."""

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getMapState("waiting", "at long, what string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for place, n in frame.groupby(["at", "what"]).size().items():
                before = self.waiting.getValue(place)[0] if self.waiting.containsKey(place) else 0
                self.waiting.updateValue(place, (before + int(n),))
        self._arm()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told, now = [], timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((at, what) for at, what in self.waiting.keys())
        start = rows[0][0] if rows else 0
        counts: Counter = Counter()
        for at, what in rows:
            if at >= start + self.width:
                told += [(start, w, n) for w, n in counts.items()]
                start, counts = at, Counter()
            if start + self.width > now:
                break
            counts[what] += self.waiting.getValue((at, what))[0]
            self.waiting.removeKey((at, what))
        told += [(start, w, n) for w, n in counts.items()]
        self._arm()
        yield pd.DataFrame([(key[0], *row) for row in told], columns=["scope", "start", "what", "n"])

    def _arm(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (first := min((at for at, _ in self.waiting.keys()), default=None)) is not None:
            self.handle.registerTimer(-(-(first + self.width) // 1000))

    def close(self) -> None:
        pass


def once_per(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events without those whose keys were seen within the delay."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Handles what has come in, batch by batch, and ends; a batch is repeated after a failure, so `each` should write by batch id."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def with_backoff(task: Callable[[], None], sleep: Callable[[float], None], base: float = 1.0, most: float = 3600.0, tries: int = 10) -> None:
    """Runs the task until it succeeds, waiting twice as long after each failure, up to `most` seconds."""
    for failures in range(tries):
        try:
            return task()
        except Exception:
            if failures == tries - 1:
                raise
            sleep(min(base * 2**failures, most))
