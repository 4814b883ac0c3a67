"""Coverage holes by blocks against a plain flood fill."""

import random

import numpy as np
import pandas as pd
import pytest

from lamina.operators import holes


def flood(there, wide, high):
    """hole -> (tiles, cx, cy) by walking from tile to tile; there[y][x] says what exists."""
    side = len(there)
    seen, out = there.astype(np.uint8), {}
    seen[high:], seen[:, wide:] = 1, 1
    for start in np.flatnonzero(~there.ravel()).tolist():
        y0, x0 = divmod(start, side)
        if seen[y0, x0]:
            continue
        stack, n, sx, sy, touches = [(x0, y0)], 0, 0, 0, False
        seen[y0, x0] = 1
        while stack:
            x, y = stack.pop()
            n, sx, sy = n + 1, sx + x, sy + y
            for u, v in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if 0 <= u < side and 0 <= v < side:
                    if there[v, u]:
                        touches = True
                    elif not seen[v, u]:
                        seen[v, u] = 1
                        stack.append((u, v))
        if touches:
            out[start] = (n, sx // n, sy // n)
    return out


def found(spark, there, **die):
    side = len(there)
    y, x = np.nonzero(there)
    tiles = spark.createDataFrame(pd.DataFrame({"tx": x, "ty": y}), "tx long, ty long")
    return {r.hole: (r.tiles, r.cx, r.cy) for r in holes.coverage_holes(tiles, side, **die).collect()}


def spiral(side):
    """A wall of one tile that winds inwards; the way between its turns is one hole."""
    there = np.zeros((side, side), bool)
    x0, y0, x1, y1 = 0, 0, side - 1, side - 1
    while x1 - x0 > 3:
        there[y0, x0 : x1 + 1] = there[y0 : y1 + 1, x1] = there[y1, x0 : x1 + 1] = True
        there[y0 + 2 : y1 + 1, x0] = True
        there[y0 + 2, x0 : x0 + 2] = True
        x0, y0, x1, y1 = x0 + 2, y0 + 2, x1 - 2, y1 - 2
    return there


def test_small_holes(spark):
    there = np.ones((6, 6), bool)
    for x, y in ((1, 1), (1, 2), (2, 2), (4, 4)):
        there[y, x] = False
    assert found(spark, there) == {7: (3, 1, 1), 28: (1, 4, 4)}


def test_margin_outside_the_die_is_no_hole(spark):
    there = np.ones((8, 8), bool)
    there[:, 6:] = False
    there[2, 5] = there[3, 1] = False
    assert found(spark, there, wide=6) == flood(there, 6, 8) == {21: (1, 5, 2), 25: (1, 1, 3)}


@pytest.mark.parametrize("side,part", [(200, 0.4), (130, 1.0)])
def test_random_holes(spark, side, part):
    r = np.random.default_rng(side)
    there = r.random((side, side)) >= part
    assert found(spark, there) == flood(there, side, side)
    if side == 200:
        assert found(spark, there, wide=150, high=70) == flood(there, 150, 70)


def test_a_hole_that_winds_through_all_blocks(spark):
    there = spiral(320)
    got = found(spark, there)
    assert got == flood(there, 320, 320) and max(n for n, _, _ in got.values()) > 20_000


def test_nothing_exists_and_nothing_is_missing(spark):
    none = spark.createDataFrame([], "tx long, ty long")
    assert holes.coverage_holes(none, 100).collect() == []
    assert holes.coverage_holes(spark.range(64 * 64).selectExpr("id % 64 AS tx", "id div 64 AS ty"), 64).collect() == []


def test_4096_by_4096(spark):
    side = 4096
    spots = "(id * 7919 + id div 13 * 104729 + id div 4099 * 31) % 101 > 3"
    tiles = spark.range(side * side).selectExpr("id", f"id % {side} AS tx", f"id div {side} AS ty").where(f"{spots} AND NOT (tx BETWEEN 500 AND 1300 AND ty BETWEEN 700 AND 1500) AND ty % 512 <> 9")
    i = np.arange(side * side)
    there = ((i * 7919 + i // 13 * 104729 + i // 4099 * 31) % 101 > 3).reshape(side, side)
    there[700:1501, 500:1301] = there[9::512] = False
    got = {r.hole: (r.tiles, r.cx, r.cy) for r in holes.coverage_holes(tiles.select("tx", "ty"), side).collect()}
    assert got == flood(there, side, side) and max(n for n, _, _ in got.values()) > 600_000


def test_components_of_made_edges(spark):
    r = random.Random(5)
    for n, m in ((300, 280), (300, 600)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1200)]
        up = {}

        def top(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = sorted((top(a), top(b)))
            up[b] = a
        want = {x: top(x) for e in edges for x in e if top(x) != x}
        got = holes.connected(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {x.node: x.root for x in got} == want and len(got) == len(want)
