"""Sessions kept online: composite state of a key (running totals, the open session, a ring of closed ones, its timer)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Closed sessions that the ring holds.
RING = 5
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "session long, first_event long, n long, y long, micros long, n_before long, y_before long, n_last long, y_last long"


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that several states of a key need, for the streams started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Sessions(StatefulProcessor):
    """Closes a session when an event comes more than `gap` microseconds after the last one, or when the watermark says that none will.

    A key's state is one value, read once and written once in a batch however many sessions close in it: number, n and y of all closed
    sessions; n and y of the last RING of them, in turn; first and last time, first event, n, y of the open session (null without one);
    when the key wakes next, and its last event's time. After `expiry` microseconds without an event all state of the key goes,
    and a later event begins anew.
    """

    def __init__(self, gap: int, expiry: int):
        self.gap, self.expiry = gap, expiry

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "sessions long, n long, y long, ring array<long>, open array<long>, at long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["event"].to_numpy(), f["us"].to_numpy(), f["y"].to_numpy()) for f in rows]
        event, us, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(event, kind="stable")
        event, us, y = event[order], us[order], y[order]
        begins = np.append(0, np.flatnonzero(np.diff(us) > self.gap) + 1)
        pieces = [np.minimum.reduceat(us, begins), np.maximum.reduceat(us, begins), us[begins], event[begins], np.diff(np.append(begins, len(us))), np.add.reduceat(y, begins)]
        closed, ring, now, at, last = self._read(self.state.get())
        out = []
        for since, latest, begin, first_event, n, of in zip(*(c.tolist() for c in pieces), strict=True):
            if now is not None and begin - now[1] > self.gap:
                out.append(self._close(now, closed, ring))
                now = None
            if last is not None and begin - last > self.expiry:  # the same whether or not the timer came before the event
                closed[:], ring[:] = [0, 0, 0], []
            last = latest
            # what a batch splits goes on: times, counts and the first event are those of the whole session
            now = [since, latest, first_event, n, of] if now is None else [min(now[0], since), max(now[1], latest), now[2], now[3] + n, now[4] + of]
        self._wake(closed, ring, now, at, (now[1] + self.gap) // 1000 + 1, now[1])
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed, ring, now, at, _ = self._read(self.state.get())
        out = []
        if now is not None:
            out.append(self._close(now, closed, ring))
            self._wake(closed, ring, None, at, (now[1] + self.expiry) // 1000 + 1, now[1])
        else:
            self.state.clear()
        yield from self._frame(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def _read(state: tuple | None) -> tuple:
        if state is None:
            return [0, 0, 0], [], None, None, None
        return list(state[:3]), list(state[3]), None if state[4] is None else list(state[4]), state[5], state[6]

    def _wake(self, closed: list, ring: list, now: list | None, before: int | None, at: int, last: int) -> None:
        """Writes the state. A key has one timer at a time."""
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.state.update((*closed, ring, now, at, last))

    @staticmethod
    def _close(now: list, closed: list, ring: list) -> tuple:
        since, last, first_event, n, y = now
        sessions, n_before, y_before = closed
        full = len(ring) == 2 * RING
        out = sessions + 1, first_event, n, y, last - since, n_before, y_before, sum(ring[::2]) if full else None, sum(ring[1::2]) if full else None
        closed[:], ring[:] = [sessions + 1, n_before + n, y_before + y], [*ring, n, y][-2 * RING :]
        return out

    @staticmethod
    def _frame(key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            names = [c.split()[0] for c in CLOSED.split(", ")]
            columns = dict(zip(names, zip(*rows, strict=True), strict=True))
            known = {c: pd.array(v, dtype="Int64") if c.endswith("_last") else np.array(v, dtype=np.int64) for c, v in columns.items()}
            yield pd.DataFrame({"key": np.full(len(rows), key[0], dtype=np.int64), **known})


def closed_sessions(stream: DataFrame, key: str, event: str, y: str, time: str, gap: int, expiry: int) -> DataFrame:
    """key and CLOSED for each session that ends: its number, first event, size, y and length, and the totals before it and of the
    RING sessions before it (null unless there are as many).

    The stream has a watermark on `time`. A key's events arrive in the order of `event`, whose times may not go back by more than
    the watermark's delay; a batch's events of a key are held at once. Sessions still open at the end stay in the state.
    """
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("event"), F.col(y).cast("long").alias("y"), time).withColumn("us", F.unix_micros(time))
    return rows.groupBy("key").transformWithStateInPandas(Sessions(gap, expiry), f"key long, {CLOSED}", "append", "EventTime")
