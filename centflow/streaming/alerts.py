"""Alerts on a stream of requests: an error rate that breaks its threshold at several checks in a row.

The windows of the error rate are ordinary streamed aggregates, so the log is reduced before anything meets in
one task: the state machine sees one row per window. A window reaches it once, when the watermark has passed
its end, hence with every late row that the watermark allows, and windows reach it in the order of time.
"""

import sys
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Python workers get the processor with the query and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INACTIVE, PENDING, FIRING, RESOLVED = "inactive", "pending", "firing", "resolved"
_OUT = "alert string, at timestamp, window_start timestamp, breach boolean, firing boolean, state string"


class HeldAlert(StatefulProcessor):
    """State per alert: start of the last window and the number of breaches in a row that end with it.

    An alert with a breach is pending, and firing from the ``checks``-th breach in a row on. It resolves with a
    window without a breach, or by a timer when the watermark passes a window that never came.
    """

    def __init__(self, every_seconds: int, checks: int) -> None:
        self._every, self._checks = every_seconds * 1000, checks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._run = handle.getValueState("run", "last long, breaches int")

    def _row(self, alert: str, start: int, breach: bool | None, state: str) -> Row:
        at, end = (datetime.fromtimestamp(ms / 1000, timezone.utc) for ms in (start, start + self._every))
        return Row(alert=alert, at=end, window_start=at, breach=breach, firing=state == FIRING, state=state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, run = self._run.get() if self._run.exists() else (None, 0)
        for r in sorted(rows, key=lambda r: r.start_ms):
            if run and r.start_ms != last + self._every:
                yield self._row(key[0], last + self._every, None, RESOLVED)
                run = 0
            before, run = run, run + 1 if r.breach else 0
            calm = RESOLVED if before else INACTIVE
            yield self._row(key[0], r.start_ms, r.breach, calm if not run else FIRING if run >= self._checks else PENDING)
            last = r.start_ms
        self._run.update((last, run))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if run:
            # the next window is due one step on; its end passes the watermark another step later
            self._handle.registerTimer(last + 2 * self._every)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, run = self._run.get() if self._run.exists() else (None, 0)
        if run and expiredTimerInfo.getExpiryTimeInMs() == last + 2 * self._every:
            self._run.update((last, 0))
            yield self._row(key[0], last + self._every, None, RESOLVED)

    def close(self) -> None:
        pass


def stream_alerts(
    log: DataFrame, alert: str = "error_rate", size_seconds: int = 300, threshold: float = 0.01, checks: int = 5,
    late: str = "1 minute",
) -> DataFrame:
    """(alert, at, window_start, breach, firing, state) of each window with requests, and a row when a missing one resolves.

    ``at`` is the end of the window and ``breach`` is null where no request came. Rows later than ``late`` do not count.
    """
    windows = (
        log.withWatermark("ts", late).groupBy(F.window("ts", f"{size_seconds} seconds").alias("w"))
        .agg(F.avg(F.col("is_error").cast("int")).alias("error_rate"))
        .select(F.lit(alert).alias("alert"), F.window_time("w").alias("at"), F.unix_millis("w.start").alias("start_ms"),
                F.coalesce(F.col("error_rate") > threshold, F.lit(False)).alias("breach"))
    )
    return windows.groupBy("alert").transformWithState(
        statefulProcessor=HeldAlert(size_seconds, checks), outputStructType=_OUT, outputMode="Append",
        timeMode="EventTime", eventTimeColumnName="at",
    )
