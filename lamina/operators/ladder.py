"""The zoom ladder: from which scale each level may be shown, and which levels are worth writing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECT_BUDGET, MAX_VIS_TILES, MIN_CELL_PX, HYSTERESIS = 2_000_000, 128, 1.5, 1.3
VIEW = (3440, 1440)


@dataclass(frozen=True)
class Rung:
    """One level: its grid, its cost per tile and its overflow cost."""

    z: int
    kind: str
    side: int
    tile: float
    rect_p95: float
    ovf_rects: float


@dataclass(frozen=True)
class Chip:
    block: float
    pitch_x: float
    pitch_y: float
    nx: int
    ny: int


def visible_tiles(r: Rung, c: Chip, s: float, view=VIEW) -> tuple[float, float]:
    """Instances and tiles on screen at scale s (pixels per unit)."""
    vw, vh = view[0] / s, view[1] / s
    inst = min(c.nx, vw / c.pitch_x + 1) * min(c.ny, vh / c.pitch_y + 1)
    across = min(r.side, min(vw, c.block) / r.tile + 1) * min(r.side, min(vh, c.block) / r.tile + 1)
    return inst, inst * across


def solve(f, target: float) -> float:
    """Least scale at which a falling function is within target, by 64 geometric bisections."""
    lo, hi = 1e-12, 1e3
    if f(lo) <= target:
        return 0.0
    if f(hi) > target:
        return math.inf
    for _ in range(64):
        mid = math.sqrt(lo * hi)
        if f(mid) > target:
            lo = mid
        else:
            hi = mid
    return hi


def bounds(r: Rung, c: Chip, mean_cell: int, view=VIEW) -> dict[str, float]:
    def rects(s):
        inst, tiles = visible_tiles(r, c, s, view)
        return tiles * r.rect_p95 + inst * r.ovf_rects

    return {
        "budget": solve(rects, RECT_BUDGET) if r.rect_p95 else 0.0,
        "tiles": solve(lambda s: visible_tiles(r, c, s, view)[1], MAX_VIS_TILES),
        "cells": 0.0 if r.kind == "far" else MIN_CELL_PX / mean_cell,
    }


def ladder(rungs: list[Rung], c: Chip, mean_cell: int, view=VIEW) -> list[dict]:
    """min_scale and what binds it of each level, coarse to fine; never falling, the first at 0."""
    out: list[dict] = []
    for r in sorted(rungs, key=lambda r: r.z):
        b = bounds(r, c, mean_cell, view)
        top = max(b.values())
        bound = next(k for k in ("budget", "tiles", "cells") if b[k] == top)
        if not out:
            top, bound = 0.0, "floor"
        elif top < out[-1]["min_scale"]:
            top, bound = out[-1]["min_scale"], "monotone"
        out.append({"z": r.z, "min_scale": top, "bound": bound, **b})
    return out


def kept(rungs: list[Rung], c: Chip, mean_cell: int, view=VIEW) -> list[Rung]:
    """Levels that are ever shown: one is dropped if the next needs no higher scale, until none is."""
    rungs = sorted(rungs, key=lambda r: r.z)
    while True:
        steps = ladder(rungs, c, mean_cell, view)
        dead = next((i for i in range(len(steps) - 1) if steps[i + 1]["min_scale"] <= steps[i]["min_scale"]), None)
        if dead is None:
            return rungs
        rungs = rungs[:dead] + rungs[dead + 1 :]


def solve_column(f, target: Column) -> Column:
    """solve() inside a plan: f takes a scale column; 64 bisections as a fold."""
    start = F.struct(F.lit(1e-12).alias("lo"), F.lit(1e3).alias("hi"))

    def step(acc, _):
        mid = F.sqrt(acc["lo"] * acc["hi"])
        over = f(mid) > target
        return F.struct(F.when(over, mid).otherwise(acc["lo"]).alias("lo"), F.when(over, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["hi"]
    return F.when(f(F.lit(1e-12)) <= target, F.lit(0.0)).when(f(F.lit(1e3)) > target, F.lit(float("inf"))).otherwise(found)


def pick_level(scales: DataFrame, steps: DataFrame) -> DataFrame:
    """The finest level of each scale (qid, scale): as-of on a ladder of few rows (z, min_scale)."""
    got = scales.join(F.broadcast(steps), F.col("min_scale") <= F.col("scale"))
    return got.groupBy("qid", "scale").agg(F.max("z").alias("z"))


def hysteresis(scales: Column, steps: list[tuple[int, float]], h: float = HYSTERESIS) -> Column:
    """Levels shown along an array of scales: in at h times a level's scale, out below it, at first by plain scale."""
    rungs = sorted(steps)

    def last(s: Column, k: float) -> Column:
        c = F.lit(0)
        for z, least in rungs:
            c = F.when(s >= F.lit(least * k), F.lit(z)).otherwise(c)
        return c

    def hold(s: Column, z: Column) -> Column:
        c = F.lit(0)
        for level, least in rungs:
            c = F.when((z == level) & (s >= F.lit(least)), F.lit(level)).otherwise(c)
        return c

    def step(acc, s):
        now = F.when(F.size(acc) == 0, last(s, 1.0)).otherwise(F.greatest(last(s, h), hold(s, F.element_at(acc, -1))))
        return F.concat(acc, F.array(now))

    return F.aggregate(scales, F.array().cast("array<int>"), step)
