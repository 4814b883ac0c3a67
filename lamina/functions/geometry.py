"""Column functions over oriented rectangles, tiles, layers and packed words.

Orientation codes are 0 N, 1 S, 2 W, 3 E, 4 FN, 5 FS, 6 FW, 7 FE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIENTATIONS = ("N", "S", "W", "E", "FN", "FS", "FW", "FE")
#: Layer bits: process layers and category layers.
PROCESS_MASK, CATEGORY_MASK = 0x0FFF, 0x7000
CELLBOX, MACROBOX, POWERBOX = 12, 13, 14


def turned(o: Column) -> Column:
    """Whether an orientation swaps width and height."""
    return o.isin(2, 3, 6, 7)


def box_w(o: Column, w: Column, h: Column) -> Column:
    return F.when(turned(o), h).otherwise(w)


def box_h(o: Column, w: Column, h: Column) -> Column:
    return F.when(turned(o), w).otherwise(h)


def _by_orientation(o: Column, values: list[Column]) -> Column:
    return reduce(lambda c, v: c.when(o == v[0], v[1]), enumerate(values[1:], 1), F.when(o == 0, values[0]))


def rect_in_box(o: Column, W: Column, H: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """A master's rectangle inside its oriented box: x, y, w, h."""
    right, up = W - x - w, H - y - h
    rx = _by_orientation(o, [x, right, up, y, right, x, up, y])
    ry = _by_orientation(o, [y, up, x, right, y, up, right, x])
    return rx, ry, box_w(o, w, h), box_h(o, w, h)


def to_chip(o: Column, side: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point of a square block in the chip, before the instance's origin is added."""
    fx, fy = side - x, side - y
    return _by_orientation(o, [x, fx, fy, y, fx, x, fy, y]), _by_orientation(o, [y, fy, x, fx, y, fy, fx, x])


def to_block(o: Column, side: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """The exact inverse of to_chip()."""
    fu, fv = side - u, side - v
    return _by_orientation(o, [u, fu, v, fv, fu, u, fv, v]), _by_orientation(o, [v, fv, fu, u, v, fv, fu, u])


def tile_of(x: Column, tile: int, side: int) -> Column:
    """Tile index of a coordinate, clamped to the grid."""
    return F.least(F.greatest(F.floor(x / tile), F.lit(0)), F.lit(side - 1)).cast("long")


def tile_key(x: str, tile: int, side: int) -> Column:
    """tile_of() of a column by integer division, for coordinates of any size."""
    return F.expr(f"least(greatest({x} div {tile}, 0L), {side - 1}L)")


def ancestor(t: Column, levels: Column | int) -> Column:
    """Tile index so many levels coarser."""
    return F.shiftright(t, levels) if isinstance(levels, int) else F.call_function("shiftright", t, levels)


def bucket_of(rc: Column, caps: list[int]) -> Column:
    """The first bucket whose cap holds a rect count, else the last."""
    last = F.lit(len(caps) - 1)
    return reduce(lambda c, i: F.when(rc <= caps[i], F.lit(i)).otherwise(c), range(len(caps) - 1, -1, -1), last)


def cap_of(rc: Column, caps: list[int]) -> Column:
    return reduce(lambda c, i: F.when(rc <= caps[i], F.lit(caps[i])).otherwise(c), range(len(caps) - 1, -1, -1), F.lit(caps[-1]))


def pack_word(m: Column, o: Column) -> Column:
    return m.bitwiseAND(65535).bitwiseOR(F.shiftleft(o, 16))


def unpack_word(word: Column) -> tuple[Column, Column]:
    return word.bitwiseAND(65535), F.shiftright(word, 16).bitwiseAND(7)


def class_layer(klass: Column) -> Column:
    """Category layer of a class; fillers share the cells' one."""
    return F.when(klass == 1, F.lit(MACROBOX)).when(klass == 2, F.lit(POWERBOX)).otherwise(F.lit(CELLBOX))


def js_round(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + F.lit(0.5))


def oversize(w: Column, h: Column, tile: int) -> Column:
    """Whether a master is too large for a level's tiles: over a quarter of the side."""
    return 4 * F.greatest(w, h) > F.lit(tile)
