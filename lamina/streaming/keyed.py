"""State machines as keyed streams: events wait in a map until the watermark passes them, then run in order.

Streams need the RocksDB state store and an event time `ts` with a watermark;
they give what the batch forms give over all events that weren't too late.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sessions import _in_order

THROTTLE_MS = 350
_THROTTLED = "user_id long, start_ms long, event_id long, n long"
_AGAIN = "user_id long, event_id long, again boolean"


def throttle(events: DataFrame, width_ms: int = THROTTLE_MS) -> DataFrame:
    """user_id, start_ms, event_id, n: the first event of a session starts a timer, the last one before it fires is kept, and the next starts another.

    Events are (user_id, ts, event_id), ordered by these; a session runs through
    one task, which holds its open timer only.
    """

    def run(frames):
        own, timer = None, None
        for f in frames:
            out = []
            for user, ms, event in f[["user_id", "ms", "event_id"]].itertuples(index=False):
                if timer and (user != own or ms >= timer[0] + width_ms):
                    out.append((own, *timer))
                    timer = None
                own, timer = user, _counted(timer, ms, event)
            yield pd.DataFrame(out, columns=["user_id", "start_ms", "event_id", "n"])
        if timer:
            yield pd.DataFrame([(own, *timer)], columns=["user_id", "start_ms", "event_id", "n"])

    rows = _in_order(events.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return rows.select("user_id", F.unix_millis("ts").alias("ms"), "event_id").mapInPandas(run, _THROTTLED)


def _counted(timer: tuple | None, ms: int, event: int) -> tuple[int, int, int]:
    """A timer (start, last event, events) after one more event."""
    return (timer[0], event, timer[2] + 1) if timer else (ms, event, 1)


def picks_again(events: DataFrame) -> DataFrame:
    """user_id, event_id, again: whether a session's pick has to be answered again after each event (user_id, ts, event_id, level, tile).

    So it is if the level isn't that of the event before, or if the tile that
    arrived wasn't there yet.
    """
    w, here = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "tile").orderBy("ts", "event_id")
    moved = ~F.col("level").eqNullSafe(F.lag("level").over(w))
    return events.select("user_id", "event_id", (moved | (F.row_number().over(here) == 1)).alias("again"))


class _InOrder(StatefulProcessor):
    """Runs `step` over a key's events by (ts, event_id), once the watermark has passed them.

    What waits are the events within the watermark's delay of a key.
    """

    columns: list[str] = []
    value = "none int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, event_id long", self.value)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            us = f["ts"].astype("datetime64[us]").astype("int64")
            for at, event, *values in zip(us, f["event_id"], *(f[c] for c in self.columns), strict=True):
                self.waiting.updateValue((int(at), int(event)), tuple(int(v) for v in values) or (0,))
            self.handle.registerTimer(int(us.min()) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator())
        due = [(k, v) for k, v in held if k[0] // 1000 < now]
        out = list(self.step(key[0], due, now))
        for k, _ in due:
            self.waiting.removeKey(k)
        if len(due) < len(held):
            self.handle.registerTimer(held[len(due)][0][0] // 1000 + 1)
        if out:
            yield pd.DataFrame(out)

    def step(self, user: int, due: list[tuple], now: int) -> Iterable[dict]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Throttle(_InOrder):
    width = THROTTLE_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "start long, event_id long, n long")

    def step(self, user, due, now):
        timer = tuple(self.open.get()) if self.open.exists() else None
        fired = lambda t: {"user_id": user, "start_ms": t[0], "event_id": t[1], "n": t[2]}
        for (us, event), _ in due:
            ms = us // 1000
            if timer and ms >= timer[0] + self.width:
                yield fired(timer)
                timer = None
            timer = _counted(timer, ms, event)
        # All events before `now` are known, so a timer of before that can fire.
        if timer and timer[0] + self.width <= now:
            yield fired(timer)
            timer = None
        if timer:
            self.open.update(timer)
            self.handle.registerTimer(timer[0] + self.width)
        else:
            self.open.clear()


class _Picks(_InOrder):
    columns = ["level", "tile"]
    value = "level long, tile long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.level = handle.getValueState("level", "level long")
        self.there = handle.getMapState("there", "tile long", "since long")

    def step(self, user, due, now):
        was = self.level.get()[0] if self.level.exists() else None
        for (us, event), (level, tile) in due:
            new = not self.there.containsKey((tile,))
            if new:
                self.there.updateValue((tile,), (us,))
            yield {"user_id": user, "event_id": event, "again": new or level != was}
            was = level
        if due:
            self.level.update((was,))


def throttle_stream(events: DataFrame, watermark: str, width_ms: int = THROTTLE_MS) -> DataFrame:
    """`throttle` over a stream; a row comes once the watermark has passed its timer."""
    processor = _Throttle()
    processor.width = width_ms
    rows = events.select("user_id", "ts", "event_id").withWatermark("ts", watermark)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, _THROTTLED, "Append", "EventTime")


def picks_stream(events: DataFrame, watermark: str) -> DataFrame:
    """`picks_again` over a stream; a session's tiles are a map in its state."""
    rows = events.select("user_id", "ts", "event_id", "level", "tile").withWatermark("ts", watermark)
    return rows.groupBy("user_id").transformWithStateInPandas(_Picks(), _AGAIN, "Append", "EventTime")
