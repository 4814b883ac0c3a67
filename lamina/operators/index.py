"""The placement index: grid, bit widths, packed records and their decoding."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import SITE, Design
from .pyramid import tiled


def bits_for(v: int) -> int:
    return 1 if v <= 1 else math.ceil(math.log2(v))


@dataclass(frozen=True)
class Packing:
    grid_x: int
    grid_y: int
    bits_x: int
    bits_y: int
    bits_m: int

    @property
    def bits(self) -> int:
        return self.bits_x + self.bits_y + self.bits_m + 3

    @property
    def fits(self) -> bool:
        """Whether a record is packed; beyond 48 bits it is kept verbatim."""
        return self.bits <= 48


def plan(d: Design, row_h: int = 1000) -> Packing:
    """The coarsest grid that every placement stands on, and the widths it needs."""
    g = d.placements().agg(F.bool_and(F.expr(f"x % {SITE} = 0")).alias("gx"), F.bool_and(F.expr(f"y % {row_h} = 0")).alias("gy")).first()
    gx, gy = SITE if g["gx"] else 1, row_h if g["gy"] else 1
    return Packing(gx, gy, bits_for(math.ceil(d.tile / gx) + 2), bits_for(math.ceil(d.tile / gy) + 2), bits_for(d.masters.count()))


def packed(d: Design, p: Packing) -> DataFrame:
    """tx, ty, pno, record: quantised local coordinates, master and orientation, low to high."""
    dx = f"(x div {p.grid_x} - tx * {d.tile}L div {p.grid_x})"
    dy = f"(y div {p.grid_y} - ty * {d.tile}L div {p.grid_y})"
    word = f"{dx} | shiftleft({dy}, {p.bits_x}) | shiftleft(m, {p.bits_x + p.bits_y}) | shiftleft(cast(o as bigint), {p.bits_x + p.bits_y + p.bits_m})"
    return tiled(d, True).selectExpr("tx", "ty", "pno", f"{word} AS record")


def decoded(records: DataFrame, d: Design, p: Packing) -> DataFrame:
    field = lambda at, bits: f"(shiftright(record, {at}) & {(1 << bits) - 1}L)"
    x = f"({field(0, p.bits_x)} + tx * {d.tile}L div {p.grid_x}) * {p.grid_x}"
    y = f"({field(p.bits_x, p.bits_y)} + ty * {d.tile}L div {p.grid_y}) * {p.grid_y}"
    at = p.bits_x + p.bits_y
    return records.selectExpr("tx", "ty", "pno", f"{field(at, p.bits_m)} AS m", f"cast({field(at + p.bits_m, 3)} as int) AS o", f"{x} AS x", f"{y} AS y")
