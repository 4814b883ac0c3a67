"""Viewport, pick, ladder and residency queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.stats import count
from ..operators import caps, ladder, prefix, view
from ..operators import pyramid as P
from ..registry import query
from ..sources.tables import Design
from .pyramid_queries import _COUNTS, _LEVEL

_PICKS = """, pk AS (SELECT event_id AS qid, (event_id * 7919) % 2500000 AS cx, (event_id * 104729) % 2500000 AS cy FROM events
), hit AS (SELECT qid, pno, m, o, x, y, bw, bh, klass, 4 * greatest(w, h) > tile AS ovf FROM pk JOIN tp ON cx >= x AND cx < x + bw AND cy >= y AND cy < y + bh)
"""


@query("j06_pick_hits", _PICKS + "SELECT qid, pno, m, klass, ovf AS is_overflow FROM hit")
def j06(spark, sf_dir):
    """All placements under each point."""
    d = Design(spark, sf_dir)
    return view.hits(d, d.picks).select("qid", "pno", "m", "klass", "is_overflow")


@query("o03_smallest_hit", _PICKS + "SELECT qid, pno, m, klass, bw * bh AS area, count(*) OVER (PARTITION BY qid) - 1 AS overlaps FROM hit QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bw * bh, ovf, pno) = 1")
def o03(spark, sf_dir):
    """The smallest placement under each point."""
    d = Design(spark, sf_dir)
    return view.best_hit(d, view.hits(d, d.picks))


@query("f09_selectable_hits", _PICKS + "SELECT qid, count(*) AS hits, count(*) FILTER (WHERE klass <> 0 AND klass <> 3) AS selectable, CASE WHEN count(*) FILTER (WHERE klass <> 0 AND klass <> 3) = 0 THEN count(*) ELSE 0 END AS filtered FROM hit GROUP BY qid")
def f09(spark, sf_dir):
    """Hits with cells switched off, and how many were filtered where nothing is left."""
    h = view.hits(Design(spark, sf_dir), Design(spark, sf_dir).picks)
    g = h.groupBy("qid").agg(count().alias("hits"), F.count_if(G.class_layer(F.col("klass")) != G.CELLBOX).alias("selectable"))
    return g.withColumn("filtered", F.when(F.col("selectable") == 0, F.col("hits")).otherwise(0).cast("long"))


@query("j07_bleed_neighbours", ", pk AS (SELECT event_id AS qid, (event_id * 7919) % 2500000 AS cx, (event_id * 104729) % 2500000 AS cy FROM events), ov AS (SELECT max(greatest(0, x - tx * tile + bw - tile, y - ty * tile + bh - tile)) AS over FROM tp WHERE NOT 4 * greatest(w, h) > tile), rg AS (SELECT qid, greatest(CAST(floor((cx - over) / tile) AS BIGINT), 0) AS ax, least(cx // tile, side - 1) AS bx, greatest(CAST(floor((cy - over) / tile) AS BIGINT), 0) AS ay, least(cy // tile, side - 1) AS byy FROM pk, ov, geo) SELECT qid, tx, unnest(range(ay, byy + 1)) AS ty FROM (SELECT *, unnest(range(ax, bx + 1)) AS tx FROM rg)")
def j07(spark, sf_dir):
    """Tiles whose content can reach each point."""
    d = Design(spark, sf_dir)
    p = d.picks.selectExpr("qid", "cx AS x0", "cy AS y0", "cx AS x1", "cy AS y1")
    return view.tiles_in(view.tile_range(p, d.tile, d.side, view.overhang(d))).select("qid", "tx", "ty")


_VIEWS = """, pitch AS (SELECT CAST(floor(world * 1.01) AS BIGINT) AS p, world AS s FROM geo
), inst AS (SELECT n_nationkey AS i, (n_nationkey % 5) * p AS ix, (n_nationkey // 5) * p AS iy, n_nationkey % 8 AS io FROM nation, pitch
), vw AS (SELECT event_id AS qid, (event_id * 7919) % 12000000 AS x0, (event_id * 104729) % 12000000 AS y0, (event_id * 7919) % 12000000 + 400000 AS x1, (event_id * 104729) % 12000000 + 300000 AS y1 FROM events
), seen AS (SELECT qid, i, io, s, x0 - ix AS u0, y0 - iy AS v0, x1 - ix AS u1, y1 - iy AS v1 FROM vw, inst, pitch WHERE ix + s >= x0 AND ix <= x1 AND iy + s >= y0 AND iy <= y1
), cor AS (SELECT qid, i,
    CASE io WHEN 0 THEN u0 WHEN 1 THEN s - u0 WHEN 2 THEN v0 WHEN 3 THEN s - v0 WHEN 4 THEN s - u0 WHEN 5 THEN u0 WHEN 6 THEN s - v0 ELSE v0 END AS ax0,
    CASE io WHEN 0 THEN v0 WHEN 1 THEN s - v0 WHEN 2 THEN s - u0 WHEN 3 THEN u0 WHEN 4 THEN v0 WHEN 5 THEN s - v0 WHEN 6 THEN s - u0 ELSE u0 END AS ay0,
    CASE io WHEN 0 THEN u1 WHEN 1 THEN s - u1 WHEN 2 THEN v1 WHEN 3 THEN s - v1 WHEN 4 THEN s - u1 WHEN 5 THEN u1 WHEN 6 THEN s - v1 ELSE v1 END AS ax1,
    CASE io WHEN 0 THEN v1 WHEN 1 THEN s - v1 WHEN 2 THEN s - u1 WHEN 3 THEN u1 WHEN 4 THEN v1 WHEN 5 THEN s - v1 WHEN 6 THEN s - u1 ELSE u1 END AS ay1 FROM seen
), bv AS (SELECT qid, i, least(ax0, ax1) AS x0, least(ay0, ay1) AS y0, greatest(ax0, ax1) AS x1, greatest(ay0, ay1) AS y1 FROM cor
), rg AS (SELECT qid, i, greatest(CAST(floor(x0 / tile) AS BIGINT), 0) AS ax, least(CAST(floor(x1 / tile) AS BIGINT), side - 1) AS bx, greatest(CAST(floor(y0 / tile) AS BIGINT), 0) AS ay, least(CAST(floor(y1 / tile) AS BIGINT), side - 1) AS byy FROM bv, geo
), vt AS (SELECT qid, i, tx, unnest(range(ay, byy + 1)) AS ty FROM (SELECT *, unnest(range(ax, bx + 1)) AS tx FROM rg WHERE ax <= bx AND ay <= byy)
), occ AS (SELECT DISTINCT tx, ty FROM tp
), cull AS (SELECT vt.* FROM vt JOIN occ USING (tx, ty))
"""


def _views(d: Design):
    return d.table("events").selectExpr("event_id AS qid", "(event_id * 7919) % 12000000 AS x0", "(event_id * 104729) % 12000000 AS y0", "(event_id * 7919) % 12000000 + 400000 AS x1", "(event_id * 104729) % 12000000 + 300000 AS y1")


def _ranges(d: Design):
    """Tile range that each view covers of each instance."""
    return view.tile_range(view.block_views(d, _views(d)), d.tile, d.side, 0).select("qid", "i", "ax", "ay", "bx", "by")


def _existing(d: Design, which: str = "true"):
    """Occupied deepest tiles, as words."""
    return prefix.words(P.tiled(d).select("tx", "ty").where(which))


def _culled(d: Design, which: str = "true"):
    """Occupied deepest tiles that each view sees of each instance."""
    return prefix.existing_in(_ranges(d), _existing(d, which)).select("qid", "i", "tx", "ty")


def _wanted(d: Design, key: str, by: str):
    """key, tx, ty, n: occupied deepest tiles by a key that views and instances share, and how many of these want them."""
    n = prefix.times_covered(_ranges(d).withColumn(key, F.expr(by)), key, d.side)
    return n.join(P.tile_counts(d).select("tx", "ty"), ["tx", "ty"], "left_semi")


@query("f01_visible_instances", _VIEWS + "SELECT qid, i FROM seen")
def f01(spark, sf_dir):
    d = Design(spark, sf_dir)
    return view.block_views(d, _views(d)).select("qid", "i")


@query("f02_tile_range", _VIEWS + 'SELECT qid, i, ax, ay, bx, byy AS "by" FROM rg WHERE ax <= bx AND ay <= byy')
def f02(spark, sf_dir):
    """Tile range that each view covers of each instance."""
    d = Design(spark, sf_dir)
    return view.tile_range(view.block_views(d, _views(d)), d.tile, d.side, 0).select("qid", "i", "ax", "ay", "bx", "by")


@query("f03_tile_exists", _VIEWS + "SELECT qid, i, count(*) AS covered, count(occ.tx) AS existing FROM vt LEFT JOIN occ USING (tx, ty) GROUP BY qid, i")
def f03(spark, sf_dir):
    """How many of the tiles covered exist."""
    d = Design(spark, sf_dir)
    r = view.tile_range(view.block_views(d, _views(d)), d.tile, d.side, 0)
    table = prefix.summed_area(P.tile_counts(d).withColumn("existing", F.lit(1)), d.side, ["existing"])
    covered = r.select("qid", "i", F.expr("(bx - ax + 1) * (by - ay + 1)").alias("covered"))
    return covered.join(prefix.rect_sums(r, ["qid", "i"], table, ["existing"]), ["qid", "i"])


@query("j05_view_cull", _VIEWS + "SELECT qid, i, tx, ty FROM cull")
def j05(spark, sf_dir):
    return _culled(Design(spark, sf_dir))


@query("u02_wanted_set", _VIEWS + "SELECT tx, ty, CAST(min(i) AS INTEGER) AS priority, count(*) AS wanted_by FROM cull GROUP BY tx, ty")
def u02(spark, sf_dir):
    """Tiles wanted by any view and instance, once each, with the best priority."""
    return _wanted(Design(spark, sf_dir), "i", "i").groupBy("tx", "ty").agg(F.min("i").alias("priority"), F.sum("n").alias("wanted_by"))


_RING = _VIEWS + """, rr AS (SELECT qid, i, greatest(ax - 1, 0) AS ax, least(bx + 1, side - 1) AS bx, greatest(ay - 1, 0) AS ay, least(byy + 1, side - 1) AS byy FROM (SELECT qid, i, CAST(floor(x0 / tile) AS BIGINT) AS ax, CAST(floor(x1 / tile) AS BIGINT) AS bx, CAST(floor(y0 / tile) AS BIGINT) AS ay, CAST(floor(y1 / tile) AS BIGINT) AS byy FROM bv, geo), geo
), rt AS (SELECT DISTINCT qid, tx, unnest(range(ay, byy + 1)) AS ty FROM (SELECT *, unnest(range(ax, bx + 1)) AS tx FROM rr WHERE ax <= bx AND ay <= byy))
"""


@query("u03_prefetch_ring", _RING + "SELECT qid, tx, ty FROM rt WHERE NOT EXISTS (SELECT 1 FROM vt WHERE vt.qid = rt.qid AND vt.tx = rt.tx AND vt.ty = rt.ty)")
def u03(spark, sf_dir):
    """Tiles one step around the visible ones."""
    d = Design(spark, sf_dir)
    # A range that lies outside the grid by less than the margin has no visible tile, and yet a ring.
    b = view.block_views(d, _views(d)).selectExpr("qid", *(f"cast(floor({c} / {d.tile}) as bigint) AS {n}" for c, n in (("x0", "ax"), ("y0", "ay"), ("x1", "bx"), ("y1", "by"))))
    return view.tiles_in(prefix.around(b, "qid", 1, d.side)).select("qid", "tx", "ty")


@query("u04_pin_set", _VIEWS + "SELECT qid, tx, ty FROM cull GROUP BY ALL UNION SELECT qid, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM cull")
def u04(spark, sf_dir):
    """Visible tiles and, as key -1, the overflow list of each view."""
    d = Design(spark, sf_dir)
    own, existing = prefix.disjoint(_ranges(d), "qid"), _existing(d)
    minus = F.lit(-1).cast("long")
    lists = prefix.not_empty(own, existing).select("qid").distinct().select("qid", minus.alias("tx"), minus.alias("ty"))
    return prefix.existing_in(own, existing).select("qid", "tx", "ty").unionByName(lists)


@query("p27_origin_table", _VIEWS + ", c AS (SELECT DISTINCT qid, i, tx, ty FROM cull) SELECT qid, c.i, tx, ty, ix + CASE io WHEN 0 THEN tx * tile WHEN 1 THEN s - tx * tile WHEN 2 THEN s - ty * tile WHEN 3 THEN ty * tile WHEN 4 THEN s - tx * tile WHEN 5 THEN tx * tile WHEN 6 THEN s - ty * tile ELSE ty * tile END AS ox FROM c JOIN inst ON c.i = inst.i, pitch, geo")
def p27(spark, sf_dir):
    """Chip origin of each (instance, tile) in view."""
    d = Design(spark, sf_dir)
    c = prefix.existing_in(_ranges(d).dropDuplicates(["qid", "i"]), _existing(d)).join(F.broadcast(d.instances.select("i", F.col("x").alias("ix"), F.col("o").alias("io"))), "i")
    u, _ = G.to_chip(F.col("io"), F.lit(d.world), F.col("tx") * d.tile, F.col("ty") * d.tile)
    return c.select("qid", "i", "tx", "ty", (F.col("ix") + u).alias("ox"))


@query("b01_visible_set_bench", _VIEWS + ", t AS (SELECT DISTINCT qid, tx, ty FROM cull) SELECT qid, count(*) AS placements, CAST(sum(rc) AS BIGINT) AS rects, count(DISTINCT m) AS masters FROM t JOIN tp USING (tx, ty) GROUP BY qid")
def b01(spark, sf_dir):
    """What each view's tiles hold."""
    d = Design(spark, sf_dir)
    ranges = view.tile_range(view.block_views(d, _views(d)), d.tile, d.side, 0)
    own = prefix.disjoint(ranges, "qid")
    per = P.tiled(d)
    table = prefix.summed_area(per.groupBy("tx", "ty").agg(count().alias("placements"), F.sum("rc").alias("rects")), d.side, ["placements", "rects"])
    sums = prefix.rect_sums(own, ["qid"], table, ["placements", "rects"]).where("placements > 0")
    return sums.join(prefix.distinct_masters(own, "qid", prefix.tile_bitmaps(per, d), d), "qid")


_STEP = ", st AS (SELECT *, qid % 10 AS step FROM cull), wn AS (SELECT DISTINCT step, tx, ty FROM st), pv AS (SELECT step + 1 AS step, tx, ty FROM wn)"


@query("j09_reconcile", _VIEWS + _STEP + "SELECT coalesce(wn.step, pv.step) AS step, coalesce(wn.tx, pv.tx) AS tx, coalesce(wn.ty, pv.ty) AS ty, CASE WHEN pv.tx IS NULL THEN 'added' WHEN wn.tx IS NULL THEN 'removed' ELSE 'kept' END AS change FROM wn FULL JOIN pv ON wn.step = pv.step AND wn.tx = pv.tx AND wn.ty = pv.ty")
def j09(spark, sf_dir):
    """Difference of wanted and resident tiles, step by step."""
    w = _wanted(Design(spark, sf_dir), "step", "qid % 10").select("step", "tx", "ty")
    return view.reconcile(w, w.withColumn("step", F.col("step") + 1), ["step", "tx", "ty"])


@query("u05_queue_actions", _VIEWS + _STEP + ", q AS (SELECT step + 1 AS step, tx, ty, (tx + ty) % 2 = 0 AS inflight FROM wn), j AS (SELECT coalesce(wn.step, q.step) AS step, CASE WHEN wn.tx IS NULL AND inflight THEN 'aborted' WHEN wn.tx IS NULL THEN 'dropped' WHEN q.tx IS NULL THEN 'new' ELSE 'waiting' END AS action FROM wn FULL JOIN q ON wn.step = q.step AND wn.tx = q.tx AND wn.ty = q.ty) SELECT step, action, count(*) AS tiles FROM j GROUP BY ALL")
def u05(spark, sf_dir):
    """Requests dropped, aborted and new at each step (T3)."""
    w = _wanted(Design(spark, sf_dir), "step", "qid % 10").select("step", "tx", "ty")
    q = w.select((F.col("step") + 1).alias("step"), "tx", "ty", F.expr("(tx + ty) % 2 = 0").alias("inflight"))
    j = w.withColumn("w", F.lit(True)).join(q, ["step", "tx", "ty"], "full")
    action = F.when(F.col("w").isNull() & F.col("inflight"), "aborted").when(F.col("w").isNull(), "dropped").when(F.col("inflight").isNull(), "new").otherwise("waiting")
    return j.groupBy("step", action.alias("action")).agg(count().alias("tiles"))


@query("o02_fetch_queue", _VIEWS + ", u AS (SELECT tx, ty, min(i) AS priority, min(abs(tx - side // 2) + abs(ty - side // 2)) AS dist FROM cull, geo GROUP BY tx, ty) SELECT tx, ty, CAST(priority AS INTEGER) AS priority, dist FROM u ORDER BY priority, dist, ty, tx LIMIT 8")
def o02(spark, sf_dir):
    """The eight requests that run first."""
    d = Design(spark, sf_dir)
    dist = F.expr(f"abs(tx - {d.side // 2}) + abs(ty - {d.side // 2})")
    return _wanted(d, "i", "i").groupBy("tx", "ty").agg(F.min("i").alias("priority"), F.min(dist).alias("dist")).orderBy("priority", "dist", "ty", "tx").limit(8)


def _rungs(d: Design):
    """Cost rows of the levels; as many rows as levels."""
    kinds = {r["z"]: r["kind"] for r in P.level_kinds(d).select("z", "kind").collect()}
    kept = P.level_summary(d).withColumnRenamed("rects", "rc")
    from ..functions.stats import nearest_rank

    p = nearest_rank(kept, ["z"], "rc", 95, "rc95").join(nearest_rank(kept, ["z"], "n", 95, "n95"), "z")
    gone = P.exploded(P.tile_summary(d), d).where(f"u > {d.max_z} - z")
    o = gone.groupBy("z").agg(F.sum("rects").alias("orc"), F.sum("n").alias("on"))
    out = []
    for r in p.join(o, "z", "left").collect():
        k = kinds[r["z"]]
        cost = {"deep": (r["rc95"], r["orc"] or 0), "mid": (r["n95"], r["on"] or 0), "far": (1024, 0)}[k]
        out.append(ladder.Rung(r["z"], k, 1 << r["z"], d.tile << (d.max_z - r["z"]), float(cost[0]), float(cost[1])))
    return out


def _chip(d: Design) -> ladder.Chip:
    pitch = int(d.world * 1.01)
    return ladder.Chip(float(d.world), float(pitch), float(pitch), 5, 5)


# Costs of levels, then 64 halvings of each bound on a logarithmic scale; the ladder is the running maximum.
_F_TILES = "least(5::DOUBLE, 3440::DOUBLE / {s} / pitch + 1) * least(5::DOUBLE, 1440::DOUBLE / {s} / pitch + 1)"
_F_ACROSS = "least(zside::DOUBLE, least(3440::DOUBLE / {s}, blk) / ztile + 1) * least(zside::DOUBLE, least(1440::DOUBLE / {s}, blk) / ztile + 1)"
_F = f"CASE what WHEN 'tiles' THEN ({_F_TILES}) * ({_F_ACROSS}) ELSE ({_F_TILES}) * ({_F_ACROSS}) * rp + ({_F_TILES}) * ov END"
_LADDER = (
    _COUNTS
    + _LEVEL
    + """, tc AS (SELECT z, tx, ty, count(*) AS n, CAST(sum(rc) AS BIGINT) AS rects FROM lr WHERE NOT ovf GROUP BY z, tx, ty
), tq AS (SELECT z, count(*) AS k, list_sort(list(n)) AS ln, list_sort(list(rects)) AS lrc FROM tc GROUP BY z
), oc AS (SELECT z, count(*) AS n, CAST(sum(rc) AS BIGINT) AS rects FROM lr WHERE ovf GROUP BY z
), rung AS (SELECT tq.z AS z, kind, side >> (maxz - tq.z) AS zside, CAST(tile << (maxz - tq.z) AS DOUBLE) AS ztile, CAST(world AS DOUBLE) AS blk, floor(world * 1.01::DOUBLE) AS pitch,
    CAST(CASE kind WHEN 'deep' THEN lrc[1 + least(k - 1, k * 95 // 100)] WHEN 'mid' THEN ln[1 + least(k - 1, k * 95 // 100)] ELSE 1024 END AS DOUBLE) AS rp,
    CAST(CASE kind WHEN 'deep' THEN coalesce(oc.rects, 0) WHEN 'mid' THEN coalesce(oc.n, 0) ELSE 0 END AS DOUBLE) AS ov
  FROM tq JOIN kinds USING (z) LEFT JOIN oc USING (z), geo
), goal AS (SELECT rung.*, what, target FROM rung, (VALUES ('budget', 2e6), ('tiles', 128e0)) AS w(what, target)
), bis AS (SELECT goal.*, 1e-12 AS lo, 1e3 AS hi, 0 AS k FROM goal
  UNION ALL SELECT * EXCLUDE (lo, hi, k, mid, v), CASE WHEN v > target THEN mid ELSE lo END, CASE WHEN v > target THEN hi ELSE mid END, k + 1
  FROM (SELECT *, """
    + _F.format(s="mid")
    + """ AS v FROM (SELECT *, sqrt(lo * hi) AS mid FROM bis WHERE k < 64))
), sol AS (SELECT z, what, CASE WHEN """
    + _F.format(s="1e-12")
    + " <= target THEN 0::DOUBLE WHEN "
    + _F.format(s="1e3")
    + """ > target THEN 'inf'::DOUBLE ELSE hi END AS least FROM bis WHERE k = 64
), bnd AS (SELECT rung.z AS z, CASE WHEN rp = 0 THEN 0 ELSE b.least END AS budget, t.least AS tiles, CASE kind WHEN 'far' THEN 0::DOUBLE ELSE 1.5::DOUBLE / round(mean_w) END AS cells
  FROM rung JOIN sol AS b ON b.z = rung.z AND b.what = 'budget' JOIN sol AS t ON t.z = rung.z AND t.what = 'tiles', means
), raw AS (SELECT *, greatest(budget, tiles, cells) AS own, z = min(z) OVER () AS first FROM bnd
), alive AS (SELECT z, z = max(z) OVER () OR CASE WHEN first THEN 0 ELSE own END < min(own) OVER (ORDER BY z ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS kept FROM raw
)
"""
)


@query("w05_ladder", _LADDER + """, m AS (SELECT *, max(CASE WHEN first THEN 0 ELSE own END) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM raw)
SELECT CAST(z AS INTEGER) AS z, CASE WHEN first THEN 0 ELSE greatest(own, before) END AS min_scale,
  CASE WHEN first THEN 'floor' WHEN own < before THEN 'monotone' WHEN budget = own THEN 'budget' WHEN tiles = own THEN 'tiles' ELSE 'cells' END AS bound, budget, tiles, cells FROM m""", recursive=True)
def w05(spark, sf_dir):
    """The zoom ladder: 64 bisections for each bound of each level (W5, A.6)."""
    d = Design(spark, sf_dir)
    rows = ladder.ladder(_rungs(d), _chip(d), round(d.means[0]))
    return spark.createDataFrame([(r["z"], r["min_scale"], r["bound"], r["budget"], r["tiles"], r["cells"]) for r in rows], "z int, min_scale double, bound string, budget double, tiles double, cells double")


@query("w06_levels_kept", _LADDER + "SELECT CAST(z AS INTEGER) AS z, kept FROM alive", recursive=True)
def w06(spark, sf_dir):
    """Levels that are ever shown, and those that others shadow (U6)."""
    d = Design(spark, sf_dir)
    rungs = _rungs(d)
    alive = {r.z for r in ladder.kept(rungs, _chip(d), round(d.means[0]))}
    return spark.createDataFrame([(r.z, r.z in alive) for r in rungs], "z int, kept boolean")


@query("p31_content_scale", _COUNTS + "SELECT CAST(z AS INTEGER) AS z, kind, CASE WHEN kind = 'far' THEN (tile << (maxz - z)) / 32.0::DOUBLE ELSE CAST(floor(mean_w + 0.5) AS DOUBLE) END AS content FROM kinds, geo, means")
def p31(spark, sf_dir):
    """What a level's content measures: a mean cell, or a density block."""
    d = Design(spark, sf_dir)
    return P.level_kinds(d).selectExpr("z", "kind", f"CASE WHEN kind = 'far' THEN ({d.tile}L * shiftleft(1L, {d.max_z} - z)) / 32.0D ELSE {float(int(d.means[0] + 0.5))}D END AS content")


@query("p28_level_costs", _COUNTS + "SELECT CAST(z AS INTEGER) AS z, mean_w * 512 / (tile << (maxz - z)) AS cell_px, least(power(4, z), 32) AS vis_t, least(power(4, z), 32) * p95 AS mid_cost FROM kinds, geo, means")
def p28(spark, sf_dir):
    d = Design(spark, sf_dir)
    return P.level_kinds(d).selectExpr("z", f"{d.means[0]!r}D * 512 / ({d.tile}L * shiftleft(1L, {d.max_z} - z)) AS cell_px", "least(power(4D, z), 32D) AS vis_t", "least(power(4D, z), 32D) * p95 AS mid_cost")


_GOLD = "(VALUES (0, 0.0), (1, 0.000193828), (2, 0.000502048), (3, 0.00117345), (6, 0.00653645)) AS g(z, s)"
_STEPS = [(0, 0.0), (1, 1.93828e-4), (2, 5.02048e-4), (3, 1.17345e-3), (6, 6.53645e-3)]


@query("j14_scale_to_level", f", v AS (SELECT event_id AS qid, 0.00002 * (1 + event_id % 500) AS s FROM events) SELECT qid, (SELECT max(z) FROM {_GOLD} WHERE CAST(g.s AS DOUBLE) <= CAST(v.s AS DOUBLE)) AS z FROM v")
def j14(spark, sf_dir):
    """The finest level that each scale may show."""
    steps = spark.createDataFrame(_STEPS, "z int, min_scale double")
    s = Design(spark, sf_dir).table("events").selectExpr("event_id AS qid", "cast(0.00002 * (1 + event_id % 500) as double) AS scale")
    return ladder.pick_level(s, steps).select("qid", "z")


@query("f19_tile_rail", _VIEWS + ", n AS (SELECT qid, count(*) AS n FROM vt GROUP BY qid) SELECT qid, CAST(min(k) AS INTEGER) AS steps FROM n, (SELECT unnest(range(0, 16)) AS k) WHERE n // (CAST(1 AS BIGINT) << (2 * k)) <= 3 GROUP BY qid")
def f19(spark, sf_dir):
    """How many levels coarser a view has to go until its tiles are few enough."""
    d = Design(spark, sf_dir)
    r = view.tile_range(view.block_views(d, _views(d)), d.tile, d.side, 0)
    n = r.groupBy("qid").agg(F.sum(F.expr("(bx - ax + 1) * (by - ay + 1)")).alias("n"))
    k = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15)))).where("n div shiftleft(1L, 2 * k) <= 3")
    return k.groupBy("qid").agg(F.min("k").alias("steps"))


@query(
    "a15_derived_caps",
    """, h AS (SELECT rc AS v, count(*) AS w FROM plc GROUP BY rc), hc AS (SELECT v, w, sum(w) OVER (ORDER BY v) AS cw, sum(w * v) OVER (ORDER BY v) AS cs, max(v) OVER () AS top, count(*) OVER () AS n FROM h
), best AS (SELECT [a.v, b.v, c.v, d.v] AS caps FROM hc AS a JOIN hc AS b ON a.v < b.v JOIN hc AS c ON b.v < c.v JOIN hc AS d ON c.v < d.v AND d.v = d.top
  ORDER BY a.cw * a.v + (b.cw - a.cw) * b.v + (c.cw - b.cw) * c.v + (d.cw - c.cw) * d.v, c.v, b.v, a.v LIMIT 1
), cut AS (SELECT unnest(CASE WHEN (SELECT max(n) FROM hc) <= 4 THEN (SELECT list_sort(list(v)) FROM h) ELSE (SELECT caps FROM best) END) AS cap
), k AS (SELECT cap, row_number() OVER (ORDER BY cap) - 1 AS bucket, coalesce(lag(cap) OVER (ORDER BY cap), 0) AS low FROM cut)
SELECT CAST(bucket AS INTEGER) AS bucket, cap, CAST(sum(w) AS BIGINT) AS placements, CAST(sum(w * v) AS BIGINT) AS actual, CAST(cap * sum(w) AS BIGINT) AS submitted FROM k JOIN h ON v > low AND v <= cap GROUP BY bucket, cap""",
)
def a15(spark, sf_dir):
    """Optimal caps of the placed rect counts, and what they submit (A15, A16)."""
    d = Design(spark, sf_dir)
    hist = {r["rc"]: r["n"] for r in d.placements().groupBy("rc").agg(count().alias("n")).collect()}
    got = caps.derive_caps(hist, 4, max(hist, default=0))
    rows, lo = [], 0
    for i, c in enumerate(got):
        own = {v: n for v, n in hist.items() if lo < v <= c}
        rows.append((i, c, sum(own.values()), sum(v * n for v, n in own.items()), c * sum(own.values())))
        lo = c
    return spark.createDataFrame(rows, "bucket int, cap long, placements long, actual long, submitted long")


@query("p35_jump_to", ", v AS (SELECT event_id, 0.0005 * (1 + event_id % 40) AS s FROM events) SELECT event_id, greatest(CAST(s AS DOUBLE), 10 / mean_w) AS scale FROM v, means")
def p35(spark, sf_dir):
    """Scale after a jump: at least ten pixels a cell, never out."""
    d = Design(spark, sf_dir)
    return d.table("events").selectExpr("event_id", f"greatest(cast(0.0005 * (1 + event_id % 40) as double), 10 / {d.means[0]!r}D) AS scale")


@query("b02_lod_sweep")
def b02(spark, sf_dir):
    """Switches of level while scale sweeps up and down in fixed steps."""
    up = F.transform(F.sequence(F.lit(0), F.lit(1800)), lambda i: F.lit(5e-5) * F.pow(F.lit(1.005), i))
    one = spark.range(1).select(F.concat(up, F.reverse(up)).alias("s"))
    z = one.select("s", ladder.hysteresis(F.col("s"), _STEPS).alias("z")).select(F.posexplode(F.arrays_zip("s", "z")).alias("i", "r"))
    rows = z.select("i", "r.s", "r.z").withColumn("was", F.lag("z").over(Window.orderBy("i")))
    return rows.where("was is not null and was <> z").select("i", F.col("s").alias("scale"), "was", "z")


@query("k06b_overflow_by_level", _LEVEL + "SELECT CAST(z AS INTEGER) AS z, klass, count(*) AS n FROM lr WHERE ovf GROUP BY z, klass")
def k06b(spark, sf_dir):
    """Classes in each level's overflow list."""
    return P.level_rows(Design(spark, sf_dir)).where("is_overflow").groupBy("z", "klass").agg(count().alias("n"))
