"""Literal rows and golden values for the rules that the tables exercise too little."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lamina.functions import geometry as G
from lamina.functions.stats import nearest_rank, weighted_rank
from lamina.operators import caps, far, ladder, place
from lamina.sources import lef
from lamina.sources.tables import numbered


def test_nearest_rank_is_not_a_disc_percentile(spark):
    df = spark.createDataFrame([(1, v) for v in range(1, 21)] + [(2, 7)], "k int, v int")
    assert {r.k: r.p for r in nearest_rank(df, ["k"], "v", 95, "p").collect()} == {1: 20, 2: 7}


def test_weighted_rank(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 7, 4), (1, 11, 1)], "k int, v int, w int")
    assert weighted_rank(df, ["k"], "v", "w", 0.5, "p").first().p == 2
    assert weighted_rank(df, ["k"], "v", "w", 0.95, "p").first().p == 11


@pytest.mark.parametrize("o", range(8))
def test_transform_inverts(spark, o):
    pts = spark.createDataFrame([(x, y) for x in (0, 3, 10) for y in (0, 7, 10)], "x long, y long").withColumn("o", F.lit(o))
    u, v = G.to_chip(F.col("o"), F.lit(10), F.col("x"), F.col("y"))
    back = pts.withColumns({"u": u, "v": v})
    bx, by = G.to_block(F.col("o"), F.lit(10), F.col("u"), F.col("v"))
    assert back.where((bx != F.col("x")) | (by != F.col("y"))).count() == 0


def test_rects_stay_in_their_box(spark):
    r = spark.createDataFrame([(o, 30, 20, 4, 5, 6, 7) for o in range(8)], "o int, mw long, mh long, x long, y long, w long, h long")
    x, y, w, h = G.rect_in_box(*(F.col(c) for c in ("o", "mw", "mh", "x", "y", "w", "h")))
    got = [tuple(t) for t in r.select(x, y, w, h).collect()]
    assert got == [(4, 5, 6, 7), (20, 8, 6, 7), (8, 4, 7, 6), (5, 20, 7, 6), (20, 5, 6, 7), (4, 8, 6, 7), (8, 20, 7, 6), (5, 4, 7, 6)]


def test_js_round_below_zero(spark):
    assert [r[0] for r in spark.createDataFrame([(-1.5,), (-0.5,), (0.5,), (2.5,)], "v double").select(G.js_round(F.col("v"))).collect()] == [-1, 0, 1, 3]


def test_straps_touch_overlap_nest_and_repeat(spark):
    rows = [("v", 0, 8, 0, 10), ("v", 0, 8, 10, 20), ("v", 0, 8, 15, 18), ("v", 0, 8, 25, 30), ("v", 0, 8, 25, 30), ("h", 0, 8, 0, 5), ("v", 0, 9, 0, 5)]
    got = far.coalesced(spark.createDataFrame(rows, "axis string, position long, thickness long, start long, end long")).collect()
    assert sorted((r.axis, r.thickness, r.start, r.end, r.segments) for r in got) == [("h", 8, 0, 5, 1), ("v", 8, 0, 20, 3), ("v", 8, 25, 30, 2), ("v", 9, 0, 5, 1)]


def test_clip_covers_each_tile_once(spark):
    box = spark.createDataFrame([(13, 5, 5, 25, 12), (14, 0, 0, 10, 10), (14, 95, 95, 200, 200)], "layer int, x0 long, y0 long, x1 long, y1 long")
    got = far.clipped(box, 10, 10).collect()
    assert sum(r.w * r.h for r in got if r.layer == 13) == 20 * 7
    assert [(r.tx, r.ty) for r in got if r.layer == 14 and r.tx < 9] == [(0, 0)]


def test_caps_are_optimal():
    r = random.Random(3)
    for _ in range(30):
        hist = {v: r.randint(1, 9) for v in r.sample(range(1, 40), 7)}
        k = r.randint(1, 4)
        got = caps.derive_caps(hist, k)

        def cost(c, hist=hist):
            return sum(n * next(x for x in c if x >= v) for v, n in hist.items())

        def best(vs, k):
            from itertools import combinations

            return min(cost(sorted({*c, vs[-1]})) for m in range(k) for c in combinations(vs, m))

        assert cost(got) == best(sorted(hist), k)
    assert caps.derive_caps({}) == [8, 16, 32, 64]
    assert caps.derive_caps({3: 1, 5: 2}, 8, 44) == [3, 44]


def test_golden_ladder():
    c = ladder.Chip(2_483_200, 2_508_032, 2_508_032, 9, 8)
    for z, scale in ((1, 1.93828e-4), (2, 5.02048e-4), (3, 1.17345e-3), (6, 6.53645e-3)):
        r = ladder.Rung(z, "mid", 1 << z, 2_483_200 / (1 << z), 14_752 if z == 6 else 1, 9_749 if z == 6 else 0)
        got = ladder.bounds(r, c, 10**9)["tiles"]
        assert abs(got - scale) <= 5e-6 * scale
    z6 = ladder.bounds(ladder.Rung(6, "deep", 64, 38_800, 14_752, 9_749), c, 10**9)
    assert abs(z6["budget"] - 6.37509e-3) <= 5e-6 * 6.37509e-3


def test_bisection_in_a_plan_is_the_same(spark):
    f = lambda s: 3.0 / s + 2.0
    col = ladder.solve_column(lambda s: 3.0 / s + 2.0, F.lit(50.0))
    assert spark.range(1).select(col).first()[0] == ladder.solve(f, 50.0)
    assert ladder.solve(lambda s: 5.0, 1.0) == math.inf
    assert ladder.solve(lambda s: 0.5, 1.0) == 0.0


def test_shadowed_levels_go():
    c = ladder.Chip(1000, 1010, 1010, 2, 2)
    rungs = [ladder.Rung(0, "far", 1, 1000, 10, 0), ladder.Rung(1, "mid", 2, 500, 10, 0), ladder.Rung(2, "mid", 4, 250, 10, 0)]
    steps = ladder.ladder(ladder.kept(rungs, c, 10), c, 10)
    assert all(a["min_scale"] < b["min_scale"] for a, b in zip(steps, steps[1:], strict=False))


def test_lef_rules(spark):
    text = "HEAD\nMACRO A\n CLASS BLOCK ;\n ORIGIN 1 0.5 ;\n SIZE 10 BY 4 ;\n PIN p\n  LAYER METAL1 ;\n   RECT 3 2 1 1 ;\n   RECT 8 3 20 9 ;\n   RECT 50 50 60 60 ;\n   POLYGON 0 0 1 1 2 2 ;\n OBS\n  LAYER METAL5 ;\n   RECT 0 0 1 1 ;\n  LAYER WEIRD ;\n   RECT 0 0 1.0005 1 ;\nEND A"
    rec = spark.createDataFrame([(x,) for x in text.split("\nMACRO ")], "value string")
    m = lef.masters_of(rec, 1000)
    assert [(r.name, r.klass, r.w, r.h) for r in m.collect()] == [("A", 1, 10000, 4000)]
    r = lef.rects_of(m, 1000).orderBy("r").collect()
    assert [(x.x, x.y, x.w, x.h, x.flags, x.layer) for x in r if x.fate == "kept"] == [(0, 500, 2000, 1000, 1, 5), (7000, 2500, 3000, 1500, 1, 5), (0, 0, 1, 500, 0, 8)]
    assert sorted(x.fate for x in r if x.fate != "kept") == ["clipped", "clipped", "polygon"]
    assert sorted(x.fold for x in r if x.fate == "kept") == ["known", "known", "unknown"]
    assert lef.rects_of(m, 1000, True).where("r = 0").first().w == 10000


def test_lef_layers_by_name_and_malformed_numbers(spark):
    names = {"METAL1": (5, "known"), "metal3": (8, "known"), "METAL9": (8, "folded"), "METAL10": (8, "unknown"), "VIA8": (6, "folded"), "VIA9": (8, "unknown"), "VIAxyz": (8, "unknown")}
    text = "A\n SIZE 9 BY 9 ;\n PIN p\n" + "".join(f"  LAYER {n} ;\n   RECT 0 0 {k + 1} 1 ;\n" for k, n in enumerate(names)) + "  LAYER METAL1 ;\n   RECT 0 0 1-2 4 ;\n   RECT 1 1 e 4 ;\nEND A"
    m = lef.masters_of(spark.createDataFrame([(text,)], "value string"), 1000)
    got = lef.rects_of(m, 1000).collect()
    assert {r.r: (r.layer, r.fold) for r in got if r.fate == "kept"} == dict(enumerate(names.values()))
    assert [r.fate for r in got if r.fate != "kept"] == ["malformed", "malformed"]
    st = lef.statements_of(spark.createDataFrame([("f", "COMPONENTS 4 ;\n- FIXED A ;\n- u1 B + PLACED ( 1-2 5 ) N ;\n- u2 PLACED + SOURCE DIST + FIXED ( 3 4 ) FS + UNPLACED ;\n - u3 C + COVER ;\n -\nEND COMPONENTS")], "file string, value string"))
    assert sorted(map(tuple, lef.components(st).collect())) == [("FIXED", "A", "UNPLACED", None, None, None), ("u1", "B", "PLACED", None, 5, "N"), ("u2", "PLACED", "UNPLACED", None, None, None), ("u3", "C", "COVER", 0, 0, "N")]


def test_lef_files_are_read_by_record(spark, tmp_path):
    (tmp_path / "a.lef").write_text("VERSION 5.8 ;\nMACRO A\n CLASS CORE ;\n SIZE 1 BY 2 ;\nEND A\nMACRO B\n CLASS CORE ;\n SIZE 3 BY 2 ;\nEND B\n")
    assert sorted(r.name for r in lef.masters_of(lef.read_macros(spark, str(tmp_path / "a.lef")), 2000).collect()) == ["A", "B"]
    (tmp_path / "a.def").write_text("UNITS DISTANCE MICRONS 2000 ;\nDIEAREA ( 0 0 ) ( 90 80 ) ;\nCOMPONENTS 2 ;\n- u1 A + PLACED ( 4 5 ) FN ;\n- u2 B\n + UNPLACED ;\nEND COMPONENTS\n")
    s = lef.read_statements(spark, str(tmp_path / "a.def"))
    assert tuple(lef.design_units(s).first()) == (2000, 0, 0, 90, 80)
    assert sorted(map(tuple, lef.components(s).collect())) == [("u1", "A", "PLACED", 4, 5, "FN"), ("u2", "B", "UNPLACED", None, None, None)]


def test_row_spans_and_fill(spark):
    boxes = spark.createDataFrame([(10, 30, 0, 1500), (20, 50, 0, 900), (90, 120, 1000, 1100)], "x0 long, x1 long, y0 long, y1 long")
    spans = place.free_spans(place.rows(spark, 2), boxes, 1000, 100)
    assert sorted((r.r, r.s, r.e) for r in spans.collect()) == [(0, 0, 10), (0, 50, 100), (1, 0, 10), (1, 30, 90)]


def sequential_fill(spans, cells):
    """The rules one span after another. spans: (s, e, x, y, step, o) in order; cells: (pno, w)."""
    total, free = sum(w for _, w in cells), sum(e - s for s, e, *_ in spans)
    out, k, carry = {}, 0, Fraction(0)
    for s, e, x0, y, step, o in spans:
        share = Fraction((e - s) * total, free) + carry
        budget, take, used = min(Fraction(e - s), share), 0, 0
        while k + take < len(cells) and used + cells[k + take][1] <= budget:
            used += cells[k + take][1]
            take += 1
        carry = share - used
        x, gap = float(s), (e - s - used) / take if take else 0
        for pno, w in cells[k : k + take]:
            at = math.floor((x - x0) / step) * step + x0
            at = at if at >= s else math.ceil((s - x0) / step) * step + x0
            if at + w > e:
                break
            out[pno] = (at, y, o)
            k += 1
            x = at + w + gap
    return {pno: out.get(pno, (None, None, None)) for pno, _ in cells}


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_fill_is_the_sequential_one(spark, blocks):
    """Roomy, tight and short spans, sites that don't meet them, and cells that are wider than most."""
    r = random.Random(blocks)
    cases = [([(10 * k, 10 * k + 10, 0, 0, 1, 0) for k in range(3)] + [(100, 1100, 0, 1000, 1, 5)], [(i, 12) for i in range(77)]), ([(150, 350, 0, 0, 200, 0), (400, 1000, 0, 0, 200, 0)], [(1, 200), (2, 200)])]
    for tight in (0.3, 0.85, 0.97, 1.0):
        spans, y = [], 0
        for _ in range(30):
            x = r.choice((0, 0, 7))
            for _ in range(r.randint(1, 4)):
                x += r.randint(0, 30)
                e = x + r.choice((3, 10, 40, 200))
                spans.append((x, e, r.choice((0, 3)), y, r.choice((1, 2, 5)), y % 2))
                x = e
            y += 1
        free, cells = sum(e - s for s, e, *_ in spans), []
        while True:
            w = r.choice((1, 2, 5, 5, 10, 25))
            if sum(c[1] for c in cells) + w > free * tight:
                break
            cells.append((3 * len(cells), w))
        cases.append((spans, cells))
    for spans, cells in cases:
        rows = [(k // 2, *sp) for k, sp in enumerate(sorted(spans, key=lambda v: (v[3], v[0])))]
        df = spark.createDataFrame(rows, "r long, s long, e long, x long, y long, step long, o int")
        order = [tuple(v[1:]) for v in sorted(rows, key=lambda v: (v[0], v[1]))]
        got = {v.pno: (v.x, v.y, v.o) for v in place.fill(df, spark.createDataFrame(cells, "pno long, w long").repartition(3), blocks).collect()}
        assert got == sequential_fill(order, cells)
    assert [tuple(v) for v in place.fill(df, spark.createDataFrame([(1, 10**6)], "pno long, w long")).collect()] == [(1, None, None, None)]
    assert [tuple(v) for v in place.fill(df.limit(0), spark.createDataFrame([(1, 0)], "pno long, w long")).collect()] == [(1, None, None, None)]


def test_fill_query_is_the_sequential_one(spark):
    import os

    from lamina.plans import chip_queries
    from lamina.sources.tables import Design

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    d = Design(spark, sf)
    spans = place.free_spans(place.rows(spark, 2512), place.obstacles(d)).orderBy("r", "s").collect()
    cells = sorted((v.pno, v.w) for v in d.placements(True).where("klass = 0").select("pno", "w").collect())
    want = sequential_fill([(v.s, v.e, 0, v.r * 1000, 200, v.r % 2 * 5) for v in spans], cells)
    assert {v.pno: (v.x, v.y, v.o) for v in chip_queries.j15(spark, sf).collect()} == want


def test_rows_of_a_design(spark):
    """Spans keep their row's origin, step, height and orientation."""
    rows = spark.createDataFrame([("b", "s", 100, 2000, "FS", 10, 1, 20, 0), ("a", "s", 50, 1000, "N", 20, 1, 10, 0)], "name string, site string, x long, y long, orient string, nx long, ny long, step long, step_y long")
    boxes = spark.createDataFrame([(100, 120, 500, 1500), (90, 110, 1999, 2001), (110, 130, 2999, 4000), (0, 500, 3000, 3100), (60, 60, 1000, 1500)], "x0 long, x1 long, y0 long, y1 long")
    got = place.row_spans(place.design_rows(rows), boxes, 1000).orderBy("r", "s").collect()
    assert [(v.r, v.s, v.e, v.x, v.y, v.step, v.orient) for v in got] == [(0, 50, 90, 50, 1000, 10, "N"), (0, 120, 250, 50, 1000, 10, "N"), (1, 130, 300, 100, 2000, 20, "FS")]


@pytest.mark.parametrize("width", [1 << 40, 3000, 50])
def test_islands_of_a_hot_line(spark, width):
    """One line with most segments, cut into spans, against a sweep; repeated segments, long ones and touching ones."""
    r = random.Random(width)
    rows = [("v", 1, 5, s, s + r.choice((0, 1, 3, 3, 400))) for s in (r.randrange(20_000) for _ in range(1500))]
    rows += rows[:20] + [("h", k % 3, 5, 10 * k, 10 * k + r.choice((5, 10))) for k in range(60)]
    want = {}
    for key in {v[:3] for v in rows}:
        for s, e in sorted(v[3:] for v in rows if v[:3] == key):
            own = want.setdefault(key, [])
            if own and s <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], e), own[-1][2] + 1)
            else:
                own.append((s, e, 1))
    df = spark.createDataFrame(rows, "axis string, position long, thickness long, start long, end long")
    got = sorted((v.axis, v.position, v.thickness, v.start, v.end, v.segments) for v in far.coalesced(df, width).collect())
    assert got == sorted((*key, *v) for key, own in want.items() for v in own)
    assert far.coalesced(df.limit(0), width).collect() == []


def test_numbering_is_a_total_order(spark):
    df = spark.range(500).selectExpr("(id * 37) % 500 AS a", "id AS b")
    got = sorted((r.n, r.a) for r in numbered(df, ("a", "b"), "n", 5).collect())
    assert [n for n, _ in got] == list(range(1, 501)) and [a for _, a in got] == sorted(a for _, a in got)


def test_pick_is_a_keyed_join(spark):
    import os

    from lamina.operators import view
    from lamina.sources.tables import Design

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    d = Design(spark, "/root/testdata/sf0.001")
    plan = view.hits(d, d.picks)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
