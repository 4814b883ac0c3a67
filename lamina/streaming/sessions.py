"""Interactive state machines, replayed over ordered events in batch and kept as keyed state in streams.

Event time needs a timestamp with a zone: readers of zone-less timestamps cast first.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import ladder


def _in_order(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Sessions whole and in order within partitions, sorted on disk if need be; none is held in memory."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, key).sortWithinPartitions(key, *order)


def level_replay(events: DataFrame, steps: list[tuple[int, float]], key: str = "user_id") -> DataFrame:
    """ord, scale and z of each session's events (key, ts, event_id, scale): hysteresis, event by event.

    A session runs through one task, which holds its current level only.
    """

    def run(frames):
        own = z = None
        n = 0
        for f in frames:
            ords, zs = [], []
            for k, scale in zip(f[key], f["scale"], strict=True):
                if k != own:
                    own, z, n = k, None, 0
                z, n = next_level(z, scale, steps), n + 1
                ords.append(n)
                zs.append(z)
            yield pd.DataFrame({key: f[key], "ord": ords, "event_id": f["event_id"], "scale": f["scale"], "z": zs})

    rows = _in_order(events.select(key, "ts", "event_id", "scale"), key, ["ts", "event_id"]).select(key, "event_id", "scale")
    return rows.mapInPandas(run, f"{key} long, ord int, event_id long, scale double, z int")


def next_level(z: int | None, scale: float, steps: list[tuple[int, float]], h: float = ladder.HYSTERESIS) -> int:
    """One step of the hysteresis."""
    first = steps[0][0]
    if z is None:
        return max((k for k, s in steps if scale >= s), default=first)
    up = max((k for k, s in steps if scale >= s * h), default=first)
    least = dict(steps)[z]
    return max(up, z) if scale >= least else up


def level_stream(events: DataFrame, steps: list[tuple[int, float]]) -> DataFrame:
    """The same state machine over a stream of (user_id, ts, event_id, scale): one row per event."""

    def step(key, frames: Iterator[pd.DataFrame], state):
        z = state.get[0] if state.exists else None
        for f in frames:
            f = f.sort_values(["ts", "event_id"])
            out = []
            for scale in f["scale"]:
                z = next_level(z, scale, steps)
                out.append(z)
            yield pd.DataFrame({"user_id": key[0], "event_id": f["event_id"].to_numpy(), "z": out})
        if z is not None:
            state.update((int(z),))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, z int", "z int", "append", GroupStateTimeout.NoTimeout)


def lru_replay(accesses: DataFrame, budget: int, key: str = "user_id") -> DataFrame:
    """A byte-budget cache per session over accesses (key, ord, tile, bytes, pinned): hits, loads, evictions and peak bytes.

    Pinned tiles stay even if they exceed the budget alone.
    """

    def run(frames):
        own = None
        free: OrderedDict = OrderedDict()  # unpinned tiles, the least recently used first
        pins: dict = {}
        stats = [0] * 4
        held = 0
        for f in frames:
            out = []
            for k, tile, size, pinned in f[[key, "tile", "bytes", "pinned"]].itertuples(index=False):
                if k != own:
                    if own is not None:
                        out.append((own, *stats))
                    own, held, stats = k, 0, [0] * 4
                    free.clear()
                    pins.clear()
                was = free.pop(tile, None) if tile in free else pins.pop(tile, None)
                if was is None:
                    stats[1] += 1
                    held += size
                else:
                    stats[0] += 1
                (pins if pinned else free)[tile] = size if was is None else was
                # The tile in use is the last of the unpinned ones and stays.
                while held > budget and len(free) > (not pinned):
                    held -= free.popitem(last=False)[1]
                    stats[2] += 1
                stats[3] = max(stats[3], held)
            yield pd.DataFrame(out, columns=[key, "hits", "loads", "evicted", "peak"])
        if own is not None:
            yield pd.DataFrame([(own, *stats)], columns=[key, "hits", "loads", "evicted", "peak"])

    return _in_order(accesses.select(key, "ord", "tile", "bytes", "pinned"), key, ["ord"]).mapInPandas(run, f"{key} long, hits long, loads long, evicted long, peak long")


def latest_per_window(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Debounce: the last event of each session and window; also over a stream, with a watermark."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    g = events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.max(F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("last.event_id").alias("event_id"), "n")


def rolling_mean(events: DataFrame, n: int = 60) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-(n - 1), 0)
    return events.withColumns({"samples": F.count("value").over(w), "mean": F.avg("value").over(w)})
