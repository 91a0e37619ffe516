"""Stateful processors without a stream: memory of a hot key, calls of the state, expiry."""

from itertools import chain

import pandas as pd
import pytest

from centflow import schemas as sc
from centflow.streaming import stateful

ARRIVED = pd.Timestamp("2026-03-23 12:00:00")
MS = ARRIVED.value // 1_000_000


class State:
    """A value state and the handle that gives it; counts what goes to the store."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def started(processor):
    state = State()
    processor.init(state)
    return processor, state


@pytest.mark.parametrize("n", [0, 7, 1000])
def test_a_hot_key_is_sorted_in_runs(monkeypatch, n):
    monkeypatch.setattr(stateful, "RUN", 50)
    monkeypatch.setattr(stateful, "PART", 20)
    rows = [(None if i % 97 == 5 else str(i * 37 % 101), None if i % 89 == 3 else f"e{i * 11 % 13}", i) for i in range(n)]
    frames = (pd.DataFrame(rows[i:i + 30], columns=["_1", "_2", "_3"]) for i in range(0, n, 30))
    parts = list(stateful._in_order(frames, ["received_at", "event_id", "class"]))
    assert all(len(p) <= 20 for p in parts)
    got = list(chain.from_iterable(p.itertuples(index=False, name=None) for p in parts))
    assert got == sorted(rows, key=lambda r: stateful._order(r[0], r[1]))


def test_many_event_ids_cost_one_state():
    columns = ["event_id", "event_type", "received_at", "_arrived", "_counts", "_group"]
    first, state = started(stateful.FirstOnly(columns, 3600))

    def batch(*rows, arrived=ARRIVED):
        frame = pd.DataFrame([(*r[:3], arrived, r[3], 1) for r in rows], columns=columns)
        out = pd.concat([*first.handleInputRows((1,), iter([frame[:len(frame) // 2], frame[len(frame) // 2:]]), None)])
        return sorted(zip(out["event_id"].fillna(""), out["received_at"], out["first"]))

    ids = [f"e{i:03d}" for i in range(500)]
    assert batch(*[(i, "a", "10", "true") for i in ids]) == [(i, "10", True) for i in ids]
    assert state.calls == 1 and state.timers == [MS + 3_600_000]
    got = batch(("e001", "a", "1", "true"), ("x", "a", "5", "true"), ("x", "a", "4", "true"), ("x", "a", "3", "false"),
                (None, "a", "2", "true"), arrived=ARRIVED + pd.Timedelta(seconds=1))
    assert got == [("", "2", True), ("e001", "1", False), ("x", "3", False), ("x", "4", True), ("x", "5", False)]
    list(first.handleExpiredTimer((1,), None, Expired(MS + 3_600_000)))
    assert sorted(map(str, state.value[0])) == ["None", "x"]
    list(first.handleExpiredTimer((1,), None, Expired(MS + 3_601_000)))
    assert state.value is None


def test_many_buckets_cost_one_state():
    columns = ["event_id", "event_type", "received_at", "_arrived", "_bucket", "_span"]
    limit, state = started(stateful.RateLimit(columns, 2, (sc.SUCCEEDED,), 3600))

    def batch(arrived=ARRIVED):
        rows = [(f"e{i:03d}", sc.SUCCEEDED if i % 3 else "other", str(i), arrived, str(i // 10), 0) for i in range(600)]
        out = pd.concat([*limit.handleInputRows(("m", 0), iter([pd.DataFrame(rows, columns=columns)]), None)])
        assert list(out.columns) == ["event_id", "event_type", "received_at", "_arrived", "position", "limited"]
        return out["position"].tolist(), out["limited"].tolist()

    positions, limited = batch()
    assert positions[:10] == [None, 1, 2, None, 3, 4, None, 5, 6, None] and limited[:5] == [False, False, False, False, True]
    assert positions[10] == 1 and state.calls == 1 and state.timers == [MS + 3_600_000]
    assert batch(ARRIVED + pd.Timedelta(seconds=1))[0][:3] == [None, 7, 8]
    list(limit.handleExpiredTimer(("m", 0), None, Expired(MS + 3_600_000)))
    assert state.value is None
