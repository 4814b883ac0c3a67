"""Drawn designs: the same every time, macros apart, rows free of macros, and the greedy choice against one by one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import draws
from lamina.operators import pyramid as P
from lamina.operators import synthetic as S
from lamina.sources.scratch import folder

SF = "/root/testdata/sf0.001"


def mix(x):
    x &= draws.MASK
    for _ in range(2):
        x = ((x ^ x >> 16) * draws.MULTIPLIER) & draws.MASK
    return x ^ x >> 16


def test_draws_as_plain_integers(spark):
    got = spark.range(200).select("id", draws.draw(7, F.col("id"), F.lit(3)).alias("v"), draws.below(7, 10, F.col("id"), F.lit(3)).alias("k")).collect()
    for r in got:
        x = 7
        for key in (r.id, 3):
            x = mix((x ^ key) + 0x9E3779B9)
        assert (r.v, r.k) == (x, x * 10 >> 32)
    assert len({r.v for r in got}) == 200 and {r.k for r in got} == set(range(10))


@pytest.mark.parametrize("n, degree", [(1, 0), (60, 1), (60, 4), (60, 30)])
def test_first_come_is_one_by_one(spark, n, degree):
    r = random.Random(n + degree)
    order = r.sample(range(1000), n)  # ids in the order of their priorities
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < degree / n}
    taken = []
    for b in range(n):
        if not any((a, b) in edges for a in taken):
            taken.append(b)
    nodes = spark.createDataFrame([(i,) for i in order], "id long")
    df = spark.createDataFrame([(order[a], order[b]) for a, b in edges], "a long, b long")
    got = S.first_come(nodes, df, folder(spark, "first"))
    assert sorted(v.id for v in got.collect()) == sorted(order[k] for k in taken)


def test_nothing_to_choose_from(spark):
    assert S.first_come(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long"), folder(spark, "none")).collect() == []


def test_macros_stay_apart(spark):
    masters = spark.createDataFrame([(m, 1, 40_000 * (1 + m % 3), 70_000, 30) for m in range(1, 9)] + [(50, 0, 400, 1000, 3), (51, 1, S.DIE + 200, 1000, 3)], "m long, klass int, w long, h long, rc long")
    got = S.macros(spark, masters, 5, copies=4, attempts=5).collect()
    places = {(v.id): v for v in S.candidates(masters, 5, 4, 5).collect()}
    apart = lambda a, b: a.x0 >= b.x1 + S.PADDING or b.x0 >= a.x1 + S.PADDING or a.y0 >= b.y1 + S.PADDING or b.y0 >= a.y1 + S.PADDING
    taken = []
    for v in sorted(places.values(), key=lambda v: (v.prio, v.id)):
        if all(v.owner != t.owner and apart(v, t) for t in taken):
            taken.append(v)
    assert sorted(v.id for v in got) == sorted(v.id for v in taken) and len(got) > 20
    assert all(0 <= v.x0 and v.x1 <= S.DIE and 0 <= v.y0 and v.y1 <= S.DIE and v.x0 % 200 == 0 and v.y0 % 1000 == 0 for v in got)
    assert all(apart(a, b) for a in got for b in got if a.id < b.id)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_design_carries_the_pyramid(spark):
    d = S.SyntheticDesign(spark, SF, 9, per_row=6, per_tile=512)
    rows = d.placements(True).collect()
    assert len(rows) == d.n and sorted(v.pno for v in rows) == list(range(1, d.n + 1))
    assert {v.klass for v in rows} == {0, 1, 2, 3}
    walls = [(v.x, v.y, *((v.h, v.w) if v.o in (2, 3, 6, 7) else (v.w, v.h))) for v in rows if v.klass == 1]
    own = [v for v in rows if v.klass in (0, 3)]
    assert not any(v.x < x + w and v.x + v.w > x and v.y < y + h and v.y + 1000 > y for v in own for x, y, w, h in walls)
    by_row = {}
    for v in own:
        by_row.setdefault(v.y, []).append((v.x, v.x + v.w))
    assert all(a[1] <= b[0] for r in by_row.values() for a, b in zip(sorted(r), sorted(r)[1:], strict=False))
    levels = P.level_kinds(d).collect()
    assert all(v.placements == d.n for v in levels) and max(v.z for v in levels) == d.max_z
    again = S.SyntheticDesign(spark, SF, 9, per_row=6, per_tile=512)
    assert sorted(map(tuple, again.stored.collect())) == sorted(map(tuple, d.stored.collect()))
