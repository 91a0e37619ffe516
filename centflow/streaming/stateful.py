"""Per-key state on streams: running z-score, device switches and rate limits.

Each processor handles the rows of one key in one micro-batch in (event time, id) order. Rows reach it
as data frames and only ``RUN`` of them are in memory at a time: sorted runs wait in a temporary file and
are merged, so a hot key costs time in one task but no memory. ``carried.py`` has the form for keys too
hot for one task. On the way through pandas all values but the time of arrival are texts (``_as_text``),
which keeps nulls, long integers and times as they are.
"""

import heapq
import pickle
import sys
from collections.abc import Iterable, Iterator
from itertools import batched
from math import sqrt
from operator import itemgetter
from tempfile import TemporaryFile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from centflow import schemas as sc
from centflow.streaming.windows import by_arrival

# Python workers get the processors with the query and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Rows that are sorted in memory, and rows of a data frame on its way through a run or out.
RUN, PART = 100_000, 2_000

#: Groups of event ids whose state is kept together, so that a large batch pays for groups and not for each id.
ID_GROUPS = 1 << 12

#: Buckets of a merchant that begin in the same span of so many seconds keep their counts together, for the same reason.
SPAN = 21_600


def _as_text(df: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """All columns but ``kept`` as text, times as microseconds."""
    return df.select(*[
        F.col(f.name) if f.name in kept else
        (F.unix_micros(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)).cast("string").alias(f.name)
        for f in df.schema.fields
    ])


def _typed(df: DataFrame, schema: T.StructType, kept: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema`` from their texts, and the further columns as they are."""
    return df.withColumns({
        f.name: F.timestamp_micros(F.col(f.name).cast("long")) if isinstance(f.dataType, T.TimestampType) else F.col(f.name).cast(f.dataType)
        for f in schema.fields if f.name not in kept
    })


def _order(at: str | None, tie: str | None) -> tuple:
    """Nulls come first."""
    return at is not None, int(at or 0), tie is not None, tie or ""


def _named(frames: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The frames under their own names; on the way to a processor those that are no Python names get lost."""
    return (frame.set_axis(columns, axis=1) for frame in frames)


def _in_order(frames: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of the frames by (received_at, event_id), equal ones as they came."""
    held: list[tuple] = []
    runs: list[list[int]] = []

    def sorted_run() -> list[tuple]:
        held.sort(key=itemgetter(0))
        return held

    def stored(offsets: list[int]) -> Iterator[tuple]:
        for offset in offsets:
            file.seek(offset)
            yield from pickle.load(file)

    with TemporaryFile() as file:
        for frame in _named(frames, columns):
            orders = map(_order, frame["received_at"].tolist(), frame["event_id"].tolist())
            held.extend(zip(orders, frame.itertuples(index=False, name=None)))
            if len(held) >= RUN:
                runs.append([])
                for part in batched(sorted_run(), PART):
                    runs[-1].append(file.tell())
                    pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
                held = []
        merged = heapq.merge(*map(stored, runs), sorted_run(), key=itemgetter(0)) if runs else sorted_run()
        for part in batched(merged, PART):
            yield pd.DataFrame([row for _, row in part], columns=columns)


class RunningZScore(StatefulProcessor):
    """State per merchant: count, mean and sum of squared deviations. A null amount counts for nothing."""

    def __init__(self, columns: list[str]) -> None:
        self._columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._stats = handle.getValueState("stats", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self._stats.get() if self._stats.exists() else (0, 0.0, 0.0)
        for part in _in_order(rows, self._columns):
            scores = []
            for text in part["amount_cents"].tolist():
                if text is None:
                    scores.append(0.0 if n < 3 else None)
                    continue
                amount = int(text)
                n += 1
                gap = amount - mean
                mean += gap / n
                m2 += gap * (amount - mean)
                std = sqrt(m2 / (n - 1)) if n > 1 and m2 > 0 else 1.0
                scores.append(0.0 if n < 3 else (amount - mean) / std)
            yield part.assign(amount_zscore=pd.Series(scores, dtype="float64"))
        self._stats.update((n, mean, m2))

    def close(self) -> None:
        pass


class DeviceSwitch(StatefulProcessor):
    """State per customer: last merchant and its time. The TTL is compared in event time."""

    def __init__(self, columns: list[str], ttl_seconds: int) -> None:
        self._columns, self._ttl = columns, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "merchant string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        merchant, at = self._last.get() if self._last.exists() else (None, 0)
        for part in _in_order(rows, self._columns):
            flags = []
            for customer, here, time in zip(part["stripe_customer_id"], part["merchant_id"], part["received_at"]):
                now = int(time)
                flags.append(int(customer not in (None, "") and merchant is not None and merchant != here and now - at <= self._ttl))
                merchant, at = here, now
            yield part.assign(device_switch_flag=flags)
        self._last.update((merchant, at))

    def close(self) -> None:
        pass


class RateLimit(StatefulProcessor):
    """State per merchant and span of buckets: events counted so far in each bucket, which expires ``ttl_seconds``
    after the first one arrived.

    Time is that of arrival (``windows.by_arrival``), so a late event is counted like any other.
    """

    def __init__(self, columns: list[str], limit: int, types: tuple[str, ...], ttl_seconds: int) -> None:
        self._columns, self._limit, self._types, self._ttl = columns, limit, types, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._counts = handle.getValueState("counts", "bucket array<string>, n array<long>, until array<long>")

    def _load(self) -> tuple[dict[str | None, int], dict[str | None, int]]:
        buckets, counts, until = self._counts.get() if self._counts.exists() else ([], [], [])
        return dict(zip(buckets, counts)), dict(zip(buckets, until))

    def _store(self, counts: dict[str | None, int], until: dict[str | None, int]) -> None:
        self._counts.update((list(counts), list(counts.values()), [until[b] for b in counts]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts, until = self._load()
        timers = set()
        for part in _in_order(rows, self._columns):
            positions = []
            for kind, bucket, arrived in zip(part["event_type"].tolist(), part["_bucket"].tolist(), part["_arrived"].tolist()):
                if bucket not in counts:
                    counts[bucket], until[bucket] = 0, _millis(arrived) + self._ttl
                    timers.add(until[bucket])
                counted = kind in self._types
                counts[bucket] += counted
                positions.append(counts[bucket] if counted else None)
            limited = [p is not None and p > self._limit for p in positions]
            yield part.drop(columns=["_bucket", "_span"]).assign(position=pd.Series(positions, dtype="object"), limited=limited)
        self._store(counts, until)
        for at in timers:
            self._handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts, until = self._load()
        left = {b: n for b, n in counts.items() if until[b] > expiredTimerInfo.getExpiryTimeInMs()}
        if left:
            self._store(left, until)
        else:
            self._counts.clear()
        return iter([])

    def close(self) -> None:
        pass


class FirstOnly(StatefulProcessor):
    """State per group of event ids: those of which a row was taken, and when; each expires ``ttl_seconds`` later."""

    def __init__(self, columns: list[str], ttl_seconds: int) -> None:
        self._columns, self._ttl = columns, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._taken = handle.getValueState("taken", "ids array<string>, at array<long>")

    def _known(self) -> dict[str | None, int]:
        return dict(zip(*self._taken.get())) if self._taken.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken, best = self._known(), {}
        columns = [c for c in self._columns if c not in ("_counts", "_group")]
        for frame in _named(rows, self._columns):
            others = []
            keys = zip(frame["event_id"].tolist(), frame["_counts"].tolist(), frame["received_at"].tolist(), frame["event_type"].tolist())
            for (event, counts, at, kind), row in zip(keys, frame[columns].itertuples(index=False, name=None)):
                order = _order(at, kind)
                if counts != "true" or event in taken:
                    others.append(row)
                elif event not in best:
                    best[event] = order, row
                elif order < best[event][0]:
                    others.append(best[event][1])
                    best[event] = order, row
                else:
                    others.append(row)
            if others:
                yield pd.DataFrame(others, columns=columns).assign(first=False)
        if not best:
            return
        firsts = pd.DataFrame([row for _, row in best.values()], columns=columns)
        arrived = [_millis(t) for t in firsts["_arrived"]]
        taken |= zip(best, arrived)
        self._taken.update((list(taken), list(taken.values())))
        for at in set(arrived):
            self._handle.registerTimer(at + self._ttl)
        yield firsts.assign(first=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        left = {event: at for event, at in self._known().items() if at + self._ttl > now}
        if left:
            self._taken.update((list(left), list(left.values())))
        else:
            self._taken.clear()
        return iter([])

    def close(self) -> None:
        pass


def _millis(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


def _with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])


def stream_zscore(events: DataFrame) -> DataFrame:
    """Add ``amount_zscore`` from the state of the event's merchant."""
    texts = _as_text(events)
    scored = texts.groupBy("merchant_id").transformWithStateInPandas(
        statefulProcessor=RunningZScore(texts.columns),
        outputStructType=_with(texts, ("amount_zscore", T.DoubleType())),
        outputMode="Append", timeMode="None",
    )
    return _typed(scored, events.schema)


def stream_device_switch(events: DataFrame, ttl_seconds: int = sc.DEVICE_TTL_SECONDS) -> DataFrame:
    """Add ``device_switch_flag`` from the state of the event's customer."""
    texts = _as_text(events)
    flagged = texts.groupBy("stripe_customer_id").transformWithStateInPandas(
        statefulProcessor=DeviceSwitch(texts.columns, ttl_seconds),
        outputStructType=_with(texts, ("device_switch_flag", T.IntegerType())),
        outputMode="Append", timeMode="None",
    )
    return _typed(flagged, events.schema)


def stream_rate_limit(
    events: DataFrame, limit: int = sc.RATE_LIMIT_PER_MINUTE, bucket_seconds: int = 60,
    types: tuple[str, ...] = (sc.SUCCEEDED,), ttl_seconds: int = 86_400,
) -> DataFrame:
    """Add ``position``, in the order of arrival by micro-batch and then of time, and ``limited``; no row is lost."""
    arrived, kept = by_arrival(events), ("_arrived", "_span")
    bucket = F.floor(F.unix_seconds("received_at") / bucket_seconds)
    texts = _as_text(arrived.withColumns({"_bucket": bucket, "_span": F.floor(bucket / max(1, SPAN // bucket_seconds))}), kept)
    out = _with(texts.drop("_bucket", "_span"), ("position", T.LongType()), ("limited", T.BooleanType()))
    counted = texts.groupBy("merchant_id", "_span").transformWithStateInPandas(
        statefulProcessor=RateLimit(texts.columns, limit, types, ttl_seconds),
        outputStructType=out, outputMode="Append", timeMode="EventTime", eventTimeColumnName="_arrived",
    )
    return _typed(counted, arrived.schema, kept).select(*events.columns, "position", "limited")


def stream_first(events: DataFrame, counts: Column, ttl_seconds: int) -> DataFrame:
    """Add ``first``: of the rows of an event id for which ``counts`` holds, the first one that came in the TTL.

    Of one micro-batch that is the one with the least (received_at, event_type). No row is lost.
    """
    arrived, kept = by_arrival(events), ("_arrived", "_group")
    grouped = arrived.withColumns({
        "_counts": F.coalesce(counts, F.lit(False)), "_group": F.pmod(F.xxhash64("event_id"), F.lit(ID_GROUPS)),
    })
    texts = _as_text(grouped, kept)
    taken = texts.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=FirstOnly(texts.columns, ttl_seconds),
        outputStructType=_with(texts.drop("_counts", "_group"), ("first", T.BooleanType())),
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="_arrived",
    )
    return _typed(taken, arrived.schema, kept).select(*events.columns, "first")
