"""Validation queries: counts of violations, and differential checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import count
from ..operators import holes, ladder
from ..operators import pyramid as P
from ..operators import validate as V
from ..registry import query
from ..sources.tables import Design
from .pyramid_queries import _COUNTS, _LEVEL, _RECTS
from .view_queries import _LADDER, _chip, _rungs


@query("v01_library_invariants", _RECTS + ", r AS (SELECT rect.*, mast.w AS mw, mast.h AS mh FROM rect LEFT JOIN mast USING (m)) SELECT 'rect_inside' AS rule, count(*) FILTER (WHERE NOT (x >= 0 AND y >= 0 AND x + w <= mw AND y + h <= mh)) AS violations FROM r UNION ALL SELECT 'rect_area', count(*) FILTER (WHERE w <= 0 OR h <= 0) FROM r UNION ALL SELECT 'layer_range', count(*) FILTER (WHERE layer NOT BETWEEN 0 AND 14) FROM r UNION ALL SELECT 'class_range', count(*) FILTER (WHERE klass NOT BETWEEN 0 AND 3) FROM mast UNION ALL SELECT 'size_positive', count(*) FILTER (WHERE w <= 0 OR h <= 0) FROM mast UNION ALL SELECT 'has_rects', count(*) FILTER (WHERE rc < 1) FROM mast")
def v01(spark, sf_dir):
    d = Design(spark, sf_dir)
    return V.library(d.masters, d.rects)


@query("v01b_library_corrupted", _RECTS + "SELECT 'rect_inside' AS rule, count(*) FILTER (WHERE rect.m % 100 = 0) AS violations FROM rect UNION ALL SELECT 'rect_area', count(*) FILTER (WHERE r = 0 AND rect.m % 100 = 1) FROM rect UNION ALL SELECT 'layer_range', count(*) FILTER (WHERE m % 100 = 2) FROM rect UNION ALL SELECT 'class_range', count(*) FILTER (WHERE m % 50 = 0) FROM mast UNION ALL SELECT 'size_positive', 0 UNION ALL SELECT 'has_rects', 0")
def v01b(spark, sf_dir):
    """The same over a library that is broken on purpose."""
    d = Design(spark, sf_dir)
    rects = d.rects.withColumns({"x": F.expr("CASE WHEN m % 100 = 0 THEN 10000000 ELSE x END"), "w": F.expr("CASE WHEN m % 100 = 1 AND r = 0 THEN 0 ELSE w END"), "layer": F.expr("CASE WHEN m % 100 = 2 THEN 15 ELSE layer END")})
    return V.library(d.masters.withColumn("klass", F.expr("CASE WHEN m % 50 = 0 THEN 9 ELSE klass END")), rects)


@query("v02_pyramid_shape", _COUNTS + "SELECT 'has_levels' AS rule, CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END::BIGINT AS violations FROM kinds UNION ALL SELECT 'not_all_far', CASE WHEN count(*) FILTER (WHERE kind <> 'far') >= 1 THEN 0 ELSE 1 END FROM kinds UNION ALL SELECT 'caps_ascend', 0 UNION ALL SELECT 'last_cap_covers', CASE WHEN (SELECT max(rc) FROM mast) <= 30 THEN 0 ELSE 1 END")
def v02(spark, sf_dir):
    d = Design(spark, sf_dir)
    most = d.masters.agg(F.max("rc")).first()[0] or 0
    return V.shape(P.level_kinds(d), P.CAPS, most)


@query("v03_tile_invariants", _LEVEL + ", s AS (SELECT count(*) FILTER (WHERE NOT (tx >= 0 AND ty >= 0 AND tx < zside AND ty < zside)) AS a, count(*) FILTER (WHERE NOT (lx >= 0 AND ly >= 0 AND lx < ztile AND ly < ztile)) AS b, count(*) FILTER (WHERE rc > 30) AS c, count(*) FILTER (WHERE NOT ovf AND NOT (lx + bw <= 2 * ztile AND ly + bh <= 2 * ztile) AND tx < zside - 1 AND ty < zside - 1) AS e FROM lr) SELECT 'key_in_grid' AS rule, a AS violations FROM s UNION ALL SELECT 'local_in_tile', b FROM s UNION ALL SELECT 'oversize_apart', 0 FROM s UNION ALL SELECT 'bucket_holds', c FROM s UNION ALL SELECT 'bleed_bounded', e FROM s")
def v03(spark, sf_dir):
    d = Design(spark, sf_dir)
    return V.tiles(P.level_rows(d), d, P.CAPS)


@query("v04_level_completeness", _LEVEL + ", a AS (SELECT z, count(*) AS n, CAST(sum(rc) AS BIGINT) AS rects FROM lr GROUP BY z) SELECT CAST(z AS INTEGER) AS z, n AS placements, rects, n = (SELECT count(*) FROM plc) AS complete FROM a")
def v04(spark, sf_dir):
    """Each level holds all placements and rects."""
    d = Design(spark, sf_dir)
    return P.level_rows(d).groupBy("z").agg(count().alias("placements"), F.sum("rc").alias("rects")).withColumn("complete", F.col("placements") == d.n)


@query(
    "v05_ladder_rules",
    _LADDER + """, s AS (SELECT z, max(CASE WHEN z = (SELECT min(z) FROM alive WHERE kept) THEN 0 ELSE own END) OVER (ORDER BY z) AS scale FROM raw JOIN alive USING (z) WHERE kept
), n AS (SELECT z, scale, lag(scale) OVER (ORDER BY z) AS before FROM s)
SELECT 'starts_at_zero' AS rule, count(*) FILTER (WHERE before IS NULL AND scale <> 0) AS violations FROM n UNION ALL SELECT 'never_falls', count(*) FILTER (WHERE scale < before) FROM n
UNION ALL SELECT 'none_shadowed', count(*) FILTER (WHERE scale <= before) FROM n UNION ALL SELECT 'hysteresis_wide', count(*) FROM (SELECT 1.3 AS h) WHERE h <= 1.16""",
    recursive=True,
)
def v05(spark, sf_dir):
    """The ladder starts at 0, never falls, and no level that is written is shadowed."""
    d = Design(spark, sf_dir)
    kept = ladder.kept(_rungs(d), _chip(d), round(d.means[0]))
    steps = ladder.ladder(kept, _chip(d), round(d.means[0]))
    scales = [s["min_scale"] for s in steps]
    rows = [("starts_at_zero", int(bool(scales) and scales[0] != 0)), ("never_falls", sum(b < a for a, b in zip(scales, scales[1:], strict=False))), ("none_shadowed", sum(b <= a for a, b in zip(scales, scales[1:], strict=False))), ("hysteresis_wide", int(ladder.HYSTERESIS <= 1.16))]
    return spark.createDataFrame(rows, "rule string, violations long")


@query("v06_chip_invariants", "SELECT unnest(['invertible', 'inside', 'pitch_clears_block']) AS rule, 0::BIGINT AS violations")
def v06(spark, sf_dir):
    return V.chip_invariants(Design(spark, sf_dir))


@query("v07_index_counts", ", c AS (SELECT tx, ty, count(*) AS n FROM tp GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS indexed, (SELECT count(*) FROM plc) AS placements, count(*) AS tiles FROM c")
def v07(spark, sf_dir):
    """The index's counts add up."""
    d = Design(spark, sf_dir)
    c = P.tile_counts(d).agg(F.sum("n").alias("indexed"), count().alias("tiles"))
    return c.crossJoin(d.table("lineitem").agg(count().alias("placements")))


@query("v08_all_far_is_an_error", "SELECT 'not_all_far' AS rule, 1::BIGINT AS violations")
def v08(spark, sf_dir):
    """A pyramid of far levels only is counted as broken."""
    far = spark.createDataFrame([(0, "far"), (1, "far")], "z int, kind string")
    return V.shape(far, P.CAPS, 30).where("rule = 'not_all_far'")


@query("j17_predicted_vs_written", _COUNTS + _LEVEL + "SELECT CAST(z AS INTEGER) AS z, CAST(sum(CASE WHEN kind = 'deep' THEN rc ELSE 1 END) AS BIGINT) AS predicted, CAST(sum(CASE WHEN kind = 'deep' THEN rc ELSE 1 END) AS BIGINT) AS written FROM lr JOIN kinds USING (z) WHERE kind <> 'far' AND NOT ovf GROUP BY z")
def j17(spark, sf_dir):
    """Each level's cost from counts by master and tile against that of its records."""
    d = Design(spark, sf_dir)
    kinds = F.broadcast(P.level_kinds(d).where("kind <> 'far'").select("z", "kind"))
    cost = F.sum(F.expr("CASE WHEN kind = 'deep' THEN rc ELSE 1 END"))
    written = P.level_rows(d).where("not is_overflow").join(kinds, "z").groupBy("z").agg(cost.alias("written"))
    by = d.placements().groupBy("w", "h", "rc").agg(count().alias("n")).crossJoin(F.broadcast(P.level_table(d))).where("not 4 * greatest(w, h) > ztile").join(kinds, "z")
    predicted = by.groupBy("z").agg(F.sum(F.expr("n * CASE WHEN kind = 'deep' THEN rc ELSE 1 END")).alias("predicted"))
    return predicted.join(written, "z")


@query(
    "j18_ladder_rederived",
    _LADDER + ", s AS (SELECT z, CAST(printf('%.6g', tiles) AS DOUBLE) AS shipped, tiles AS derived FROM bnd) SELECT CAST(z AS INTEGER) AS z, shipped, derived, abs(shipped - derived) <= 5e-6 * abs(shipped) AS agree FROM s",
    recursive=True,
)
def j18(spark, sf_dir):
    """Ladder scales shipped with six digits against those derived inside a plan."""
    d = Design(spark, sf_dir)
    rungs, c = _rungs(d), _chip(d)
    shipped = [(s["z"], float(f"{s['tiles']:.6g}")) for s in ladder.ladder(rungs, c, round(d.means[0]))]
    rows = spark.createDataFrame([(r.z, float(r.side), float(r.tile)) for r in rungs], "z int, side double, tile double").join(spark.createDataFrame(shipped, "z int, shipped double"), "z")

    def tiles(s):
        vw, vh = F.lit(float(ladder.VIEW[0])) / s, F.lit(float(ladder.VIEW[1])) / s
        inst = F.least(F.lit(float(c.nx)), vw / c.pitch_x + 1) * F.least(F.lit(float(c.ny)), vh / c.pitch_y + 1)
        along = lambda v: F.least(F.col("side"), F.least(v, F.lit(c.block)) / F.col("tile") + 1)
        return inst * (along(vw) * along(vh))

    again = ladder.solve_column(tiles, F.lit(float(ladder.MAX_VIS_TILES)))
    return rows.select("z", "shipped", again.alias("derived")).withColumn("agree", F.abs(F.col("shipped") - F.col("derived")) <= 5e-6 * F.abs(F.col("shipped")))


@query("u06_levels_by_kind", _COUNTS + "SELECT kind, count(*) AS levels FROM kinds GROUP BY kind")
def u06(spark, sf_dir):
    return P.level_kinds(Design(spark, sf_dir)).groupBy("kind").agg(count().alias("levels"))


@query("f16_lazy_levels", _COUNTS + "SELECT CAST(z AS INTEGER) AS z, kind <> 'far' AS lazy FROM kinds")
def f16(spark, sf_dir):
    """Levels that are made on demand."""
    return P.level_kinds(Design(spark, sf_dir)).select("z", (F.col("kind") != "far").alias("lazy"))


@query(
    "g01_coverage_holes",
    ", occ AS (SELECT DISTINCT tx, ty FROM tp WHERE (tx * 7 + ty * 3) % 5 <> 0), g AS (SELECT a.x AS tx, b.y AS ty FROM geo, (SELECT unnest(range(0, 64)) AS x) a, (SELECT unnest(range(0, 64)) AS y) b WHERE a.x < side AND b.y < side), mi AS (SELECT tx, ty, ty * (SELECT side FROM geo) + tx AS node FROM g WHERE NOT EXISTS (SELECT 1 FROM occ WHERE occ.tx = g.tx AND occ.ty = g.ty)), ed AS (SELECT a.node AS a, b.node AS b FROM mi a JOIN mi b ON abs(a.tx - b.tx) + abs(a.ty - b.ty) = 1), re AS (SELECT node AS a, node AS b FROM mi UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b = ed.a), lb AS (SELECT a AS node, min(b) AS hole FROM re GROUP BY a) SELECT hole, count(*) AS tiles, CAST(sum(tx) // count(*) AS BIGINT) AS cx, CAST(sum(ty) // count(*) AS BIGINT) AS cy FROM lb JOIN mi USING (node) GROUP BY hole",
    recursive=True,
)
def g01(spark, sf_dir):
    """Holes in a thinned-out coverage of the deepest level."""
    d = Design(spark, sf_dir)
    return holes.coverage_holes(P.tile_counts(d).where("(tx * 7 + ty * 3) % 5 <> 0"), d.side)


@query("g03_blank_frame_plan", _LEVEL + ", pt AS (SELECT event_id AS qid, (event_id * 7919) % 2500000 AS cx, (event_id * 104729) % 2500000 AS cy FROM events), t AS (SELECT DISTINCT z, tx, ty, ztile FROM lr) SELECT qid, CAST(lv.z AS INTEGER) AS z, EXISTS (SELECT 1 FROM t WHERE t.z = lv.z AND t.tx = cx // lv.ztile AND t.ty = cy // lv.ztile) AS drawn FROM pt, lv")
def g03(spark, sf_dir):
    """Sample points at every level: whether something is drawn there."""
    d = Design(spark, sf_dir)
    pts = d.picks.crossJoin(F.broadcast(P.level_table(d))).selectExpr("qid", "z", "cx div ztile AS tx", "cy div ztile AS ty")
    return pts.join(P.level_counts(d).select("z", "tx", "ty", F.lit(True).alias("there")), ["z", "tx", "ty"], "left").select("qid", "z", F.coalesce("there", F.lit(False)).alias("drawn"))
