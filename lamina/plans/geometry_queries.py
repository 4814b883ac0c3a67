"""Queries of projections: orientation, packing, tile keys, masks, colours and cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.stats import count
from ..operators import pyramid as P
from ..registry import query
from ..sources.tables import Design
from .pyramid_queries import _LEVEL, _RECTS


@query("p01_oriented_box", "SELECT pno, bw, bh FROM tp")
def p01(spark, sf_dir):
    t = P.tiled(Design(spark, sf_dir), True)
    return t.select("pno", "bw", "bh")


_TURN = """, f AS (SELECT tx, ty, o, p.w AS mw, p.h AS mh, p.x AS px, p.y AS py, r.x, r.y, r.w, r.h, r.layer FROM tp AS p JOIN rect AS r USING (m) WHERE tx = 0 AND ty = 0
), d AS (SELECT o, layer, px + CASE o WHEN 0 THEN x WHEN 1 THEN mw - x - w WHEN 2 THEN mh - y - h WHEN 3 THEN y WHEN 4 THEN mw - x - w WHEN 5 THEN x WHEN 6 THEN mh - y - h ELSE y END AS x,
   py + CASE o WHEN 0 THEN y WHEN 1 THEN mh - y - h WHEN 2 THEN x WHEN 3 THEN mw - x - w WHEN 4 THEN y WHEN 5 THEN mh - y - h WHEN 6 THEN mw - x - w ELSE x END AS y,
   CASE WHEN o IN (2, 3, 6, 7) THEN h ELSE w END AS w, CASE WHEN o IN (2, 3, 6, 7) THEN w ELSE h END AS h FROM f)
"""


@query("j04_drawn_rects", _RECTS + _TURN + "SELECT o, layer, x, y, w, h FROM d")
def j04(spark, sf_dir):
    """Every drawn rectangle of one tile: placements filtered first, then expanded and turned (P2)."""
    d = Design(spark, sf_dir)
    p = P.tiled(d).where("tx = 0 and ty = 0").select("m", "o", F.col("x").alias("px"), F.col("y").alias("py"), F.col("w").alias("mw"), F.col("h").alias("mh"))
    r = p.join(d.rects, "m")
    x, y, w, h = G.rect_in_box(F.col("o"), F.col("mw"), F.col("mh"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return r.select("o", "layer", (F.col("px") + x).alias("x"), (F.col("py") + y).alias("y"), w.alias("w"), h.alias("h"))


@query("p02_rect_orientations", _RECTS + """SELECT m, r, o, CASE o WHEN 0 THEN rect.x WHEN 5 THEN rect.x WHEN 1 THEN mast.w - rect.x - rect.w WHEN 4 THEN mast.w - rect.x - rect.w WHEN 2 THEN mast.h - rect.y - rect.h WHEN 6 THEN mast.h - rect.y - rect.h ELSE rect.y END AS x
FROM rect JOIN mast USING (m), (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS o)""")
def p02(spark, sf_dir):
    """The eight orientations of every master's rects."""
    d = Design(spark, sf_dir)
    r = d.rects.join(d.masters.select("m", F.col("w").alias("mw"), F.col("h").alias("mh")), "m").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(7))))
    x, *_ = G.rect_in_box(F.col("o"), F.col("mw"), F.col("mh"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return r.select("m", "r", "o", x.alias("x"))


@query("p04_pack_word", ", d AS (SELECT DISTINCT m, o FROM plc) SELECT m, o, (m & 65535) | (CAST(o AS BIGINT) << 16) AS word, (m & 65535) AS m_back, CAST(o AS BIGINT) AS o_back FROM d")
def p04(spark, sf_dir):
    """Packed placement words, and what unpacking gives."""
    p = Design(spark, sf_dir).placements().select("m", "o").distinct().withColumn("word", G.pack_word(F.col("m"), F.col("o").cast("long")))
    m, o = G.unpack_word(F.col("word"))
    return p.select("m", "o", "word", m.alias("m_back"), o.cast("long").alias("o_back"))


@query("p06_tile_keys", "SELECT pno, tx, ty, ty * side + tx AS idx, concat_ws('/', maxz, tx, ty) AS key FROM tp")
def p06(spark, sf_dir):
    """Deepest tile key of each placement, as numbers and as text (P33)."""
    d = Design(spark, sf_dir)
    return P.tiled(d, True).selectExpr("pno", "tx", "ty", f"ty * {d.side} + tx AS idx", f"concat_ws('/', {d.max_z}, tx, ty) AS key")


@query("p07_ancestor_keys", ", t AS (SELECT DISTINCT tx, ty FROM tp) SELECT tx, ty, CAST(z AS INTEGER) AS z, tx >> up AS ax, ty >> up AS ay FROM t, lv")
def p07(spark, sf_dir):
    d = Design(spark, sf_dir)
    t = P.tile_counts(d).select("tx", "ty").withColumns({"ox": F.col("tx"), "oy": F.col("ty")})
    return P.exploded(t, d).selectExpr("ox AS tx", "oy AS ty", "z", "tx AS ax", "ty AS ay")


@query("p08_local_coordinates", _LEVEL + "SELECT CAST(z AS INTEGER) AS z, CAST(sum(lx) AS BIGINT) AS lx, CAST(sum(ly) AS BIGINT) AS ly, min(lx) AS lo, max(ly) AS hi FROM lr GROUP BY z")
def p08(spark, sf_dir):
    """Tile-local coordinates, summed up by level."""
    return P.level_rows(Design(spark, sf_dir)).groupBy("z").agg(F.sum("lx").alias("lx"), F.sum("ly").alias("ly"), F.min("lx").alias("lo"), F.max("ly").alias("hi"))


@query("p09_rect_bucket", "SELECT m, rc, CASE WHEN rc <= 4 THEN 0 WHEN rc <= 6 THEN 1 WHEN rc <= 8 THEN 2 ELSE 3 END AS bucket FROM mast")
def p09(spark, sf_dir):
    return Design(spark, sf_dir).masters.select("m", "rc", G.bucket_of(F.col("rc"), P.CAPS).alias("bucket"))


@query("p10_class_layer", "SELECT m, klass, CASE klass WHEN 1 THEN 13 WHEN 2 THEN 14 ELSE 12 END AS layer FROM mast")
def p10(spark, sf_dir):
    return Design(spark, sf_dir).masters.select("m", "klass", G.class_layer(F.col("klass")).alias("layer"))


@query("p14_pyramid_geometry", "SELECT n, CAST(maxz AS INTEGER) AS max_z, side, tile, world FROM geo")
def p14(spark, sf_dir):
    d = Design(spark, sf_dir)
    return spark.createDataFrame([(d.n, d.max_z, d.side, d.tile, d.world)], "n long, max_z int, side long, tile long, world long")


@query("p15_block_edges", ", i AS (SELECT unnest(range(0, 129)) AS i) SELECT i, CAST(floor(i * CAST(world AS DOUBLE) / 128 + 0.5) AS BIGINT) AS edge FROM i, geo")
def p15(spark, sf_dir):
    d = Design(spark, sf_dir)
    return spark.range(129).select(F.col("id").alias("i"), G.js_round(F.col("id") * F.lit(float(d.world)) / 128).cast("long").alias("edge"))


@query("p17_view_bounds", ", v AS (SELECT event_id AS qid, (event_id * 7919) % 2500000 AS cx, (event_id * 104729) % 2500000 AS cy, 0.0005 * (1 + event_id % 40) AS s FROM events) SELECT qid, cx - 3440 / (2 * CAST(s AS DOUBLE)) AS x0, cy - 1440 / (2 * CAST(s AS DOUBLE)) AS y0, cx + 3440 / (2 * CAST(s AS DOUBLE)) AS x1, cy + 1440 / (2 * CAST(s AS DOUBLE)) AS y1 FROM v")
def p17(spark, sf_dir):
    """World rectangle of each camera."""
    v = Design(spark, sf_dir).picks.withColumn("s", F.expr("cast(0.0005 * (1 + qid % 40) as double)"))
    return v.selectExpr("qid", "cx - 3440 / (2 * s) AS x0", "cy - 1440 / (2 * s) AS y0", "cx + 3440 / (2 * s) AS x1", "cy + 1440 / (2 * s) AS y1")


@query("p18_camera_zoom_fold", ", w AS (SELECT user_id, ts, event_id, value FROM events), s AS (SELECT user_id, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS steps FROM w GROUP BY user_id) SELECT user_id, CAST(steps AS BIGINT) AS steps, power(2.0, steps / 8.0) AS scale FROM s")
def p18(spark, sf_dir):
    """Zoom sequence of each session: a step in or out for each event, as one exponent."""
    e = Design(spark, sf_dir).table("events")
    s = e.groupBy("user_id").agg(F.sum(F.expr("CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END")).alias("steps"))
    return s.select("user_id", "steps", F.pow(F.lit(2.0), F.col("steps") / 8.0).alias("scale"))


@query("p19_project_and_depth", ", c AS (SELECT m, klass FROM mast) SELECT m, 1 - CASE klass WHEN 1 THEN 13 WHEN 2 THEN 14 ELSE 12 END / 16.0::DOUBLE AS depth FROM c")
def p19(spark, sf_dir):
    """Depth key of each master's category layer."""
    return Design(spark, sf_dir).masters.select("m", (1 - G.class_layer(F.col("klass")) / F.lit(16.0)).alias("depth"))


@query("p20_screen_to_world", ", v AS (SELECT event_id AS qid, (event_id * 7919) % 2500000 AS cx, (event_id * 104729) % 2500000 AS cy, 0.25::DOUBLE AS s FROM events) SELECT qid, cx + (qid % 3440 - 1720) / s AS wx, cy + (qid % 1440 - 720) / s AS wy FROM v")
def p20(spark, sf_dir):
    return Design(spark, sf_dir).picks.selectExpr("qid", "cx + (qid % 3440 - 1720) / 0.25D AS wx", "cy + (qid % 1440 - 720) / 0.25D AS wy")


@query("p22_mask_algebra", ", e AS (SELECT event_id, event_id % 32768 AS mask, (event_id * 31) % 32768 AS off FROM events) SELECT event_id, mask & (32767 - off) AS effective, mask & off AS ignored, mask & 4095 AS process, mask & 28672 AS category FROM e")
def p22(spark, sf_dir):
    """Effective and ignored layers of masks."""
    e = Design(spark, sf_dir).table("events").selectExpr("event_id", "event_id % 32768 AS mask", "(event_id * 31) % 32768 AS off")
    return e.selectExpr("event_id", "mask & ~off & 32767 AS effective", "mask & off AS ignored", "mask & 4095 AS process", "mask & 28672 AS category")


@query("p23_solo_toggle", ", e AS (SELECT event_id, event_id % 32768 AS mask, CAST(1 AS BIGINT) << (event_id % 15) AS bit FROM events) SELECT event_id, CASE WHEN mask = bit THEN 32767 ELSE bit END AS solo, xor(mask, bit) AS toggled, CASE WHEN mask & 4095 <> 0 THEN mask & 28672 ELSE mask | 4095 END AS group_toggled FROM e")
def p23(spark, sf_dir):
    """Masks after solo, toggle and group toggle (any on: all off)."""
    e = Design(spark, sf_dir).table("events").selectExpr("event_id", "event_id % 32768 AS mask", "shiftleft(1L, cast(event_id % 15 as int)) AS bit")
    return e.selectExpr("event_id", "CASE WHEN mask = bit THEN 32767L ELSE bit END AS solo", "mask ^ bit AS toggled", "CASE WHEN mask & 4095 <> 0 THEN mask & 28672 ELSE mask | 4095 END AS group_toggled")


@query("p24_row_applicability", ", l AS (SELECT unnest(range(0, 15)) AS layer), k AS (SELECT unnest(['deep', 'mid', 'far']) AS kind) SELECT layer, kind, CASE WHEN layer >= 12 THEN true ELSE kind = 'deep' END AS applies FROM l, k")
def p24(spark, sf_dir):
    """Process layers apply where rects are drawn, category layers at any level."""
    k = F.explode(F.array(F.lit("deep"), F.lit("mid"), F.lit("far"))).alias("kind")
    return spark.range(15).select(F.col("id").alias("layer"), k).withColumn("applies", F.expr("layer >= 12 or kind = 'deep'"))


@query("p25_slot_records", ", s AS (SELECT tx, ty, row_number() OVER (ORDER BY ty, tx) - 1 AS slot FROM (SELECT DISTINCT tx, ty FROM tp)) SELECT slot, count(*) AS records, CAST(sum((m & 65535) | (CAST(o AS BIGINT) << 16)) AS BIGINT) AS words FROM tp JOIN s USING (tx, ty) GROUP BY slot")
def p25(spark, sf_dir):
    """Placement records summed up by their tile's slot; slots number tiles row by row."""
    from pyspark.sql import Window

    tiles = P.tiled(Design(spark, sf_dir)).groupBy("tx", "ty").agg(count().alias("records"), F.sum(G.pack_word(F.col("m"), F.col("o").cast("long"))).alias("words"))
    # A rank within each row of tiles, shifted by the rows' counts: as many rows as the grid has.
    row = tiles.groupBy("ty").agg(count().alias("n"))
    before = Window.orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)
    start = row.select("ty", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("ty").orderBy("tx"))
    return tiles.withColumn("at", inside).join(start, "ty").select((F.col("start") + F.col("at") - 1).alias("slot"), "records", "words")


@query("p33_key_strings", ", t AS (SELECT DISTINCT tx, ty, maxz FROM tp) SELECT concat_ws('/', maxz, tx, ty) AS key, 'z' || maxz || '/overflow' AS overflow_key, 'tiles/' || maxz || '/' || tx || '_' || ty || '.bin' AS path FROM t")
def p33(spark, sf_dir):
    d = Design(spark, sf_dir)
    z = d.max_z
    return P.tile_counts(d).selectExpr(f"concat_ws('/', {z}, tx, ty) AS key", f"'z{z}/overflow' AS overflow_key", f"concat('tiles/{z}/', tx, '_', ty, '.bin') AS path")


@query("p34_design_summary", "SELECT 'placements ' || n || ', levels ' || (maxz + 1) || ', tile ' || tile AS line FROM geo")
def p34(spark, sf_dir):
    d = Design(spark, sf_dir)
    return d.table("lineitem").agg(F.count(F.lit(1)).alias("n")).select(F.format_string(f"placements %d, levels {d.max_z + 1}, tile {d.tile}", "n").alias("line"))


@query("p36_floor_flags", ", v AS (SELECT event_id, value, 0.5 + (event_id % 7) / 10.0 AS s FROM events) SELECT event_id, CAST(s AS DOUBLE) <= 0.85 * 1.000001 AS at_floor, event_id % 5 = 0 AS translucent, (100 - event_id % 100) / 100.0::DOUBLE AS waste FROM v")
def p36(spark, sf_dir):
    """Zoom-floor and translucency flags, and buffer waste."""
    e = Design(spark, sf_dir).table("events")
    return e.selectExpr("event_id", "cast(0.5 + (event_id % 7) / 10.0 as double) <= 0.85D * 1.000001D AS at_floor", "event_id % 5 = 0 AS translucent", "(100 - event_id % 100) / 100.0D AS waste")


@query("f07_subpixel_skip", "SELECT tx, ty, count(*) FILTER (WHERE greatest(w, h) * 0.0005::DOUBLE >= 1.0) AS drawn, count(*) FILTER (WHERE greatest(w, h) * 0.0005::DOUBLE < 1.0) AS skipped FROM tp GROUP BY tx, ty")
def f07(spark, sf_dir):
    """Placements too small to draw at a scale, by tile."""
    px = F.greatest("w", "h") * F.lit(0.0005)
    return P.tiled(Design(spark, sf_dir)).groupBy("tx", "ty").agg(F.count_if(px >= 1.0).alias("drawn"), F.count_if(px < 1.0).alias("skipped"))


@query("f08_layer_hidden", _RECTS + "SELECT layer, count(*) AS rects, (2730 >> layer) & 1 AS hidden FROM rect GROUP BY layer")
def f08(spark, sf_dir):
    return Design(spark, sf_dir).rects.groupBy("layer").agg(count().alias("rects")).withColumn("hidden", F.expr("shiftright(2730, layer) & 1"))


@query("j01_placement_master", "SELECT klass, count(*) AS n, CAST(sum(w) AS BIGINT) AS width, CAST(sum(rc) AS BIGINT) AS rects FROM plc GROUP BY klass")
def j01(spark, sf_dir):
    """Placements with their masters, summed up by class."""
    return Design(spark, sf_dir).placements().groupBy("klass").agg(count().alias("n"), F.sum("w").alias("width"), F.sum("rc").alias("rects"))


@query("j03_master_rects", _RECTS + "SELECT mast.m, rc, count(r) AS rects, CAST(sum(rect.w * rect.h) AS BIGINT) AS area FROM mast LEFT JOIN rect USING (m) GROUP BY mast.m, rc")
def j03(spark, sf_dir):
    d = Design(spark, sf_dir)
    return d.masters.select("m", "rc").join(d.rects.select("m", "r", "w", "h"), "m", "left").groupBy("m", "rc").agg(F.count("r").alias("rects"), F.sum(F.expr("w * h")).alias("area"))


@query("j08_deepest_to_ancestor", ", c AS (SELECT tx, ty, count(*) AS n FROM tp GROUP BY ALL) SELECT tx >> 1 AS ax, ty >> 1 AS ay, count(*) AS children, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2")
def j08(spark, sf_dir):
    """Deepest tiles of each parent."""
    c = P.tile_counts(Design(spark, sf_dir))
    return c.groupBy(F.expr("shiftright(tx, 1)").alias("ax"), F.expr("shiftright(ty, 1)").alias("ay")).agg(count().alias("children"), F.sum("n").alias("n"))


@query("j13_inverse_cdf", ", k AS (SELECT m, 1 + m % 97 AS wt FROM mast), c AS (SELECT m, sum(wt) OVER (ORDER BY m) AS hi, sum(wt) OVER (ORDER BY m) - wt AS lo, sum(wt) OVER () AS total FROM k), u AS (SELECT event_id, (event_id * 104729) % (SELECT sum(wt) FROM k) AS u FROM events) SELECT event_id, m FROM u JOIN c ON u.u >= lo AND u.u < hi")
def j13(spark, sf_dir):
    """Weighted draw of a master: an as-of lookup on the running weight.

    Both sides are cut at multiples of a stride, so that the lookup is an equi-join with a short range check.
    """
    from pyspark.sql import Window

    d = Design(spark, sf_dir)
    k = d.masters.selectExpr("m", "1 + m % 97 AS wt", "m div 1024 AS part")
    parts = k.groupBy("part").agg(F.sum("wt").alias("s"))
    before = parts.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("s").over(Window.partitionBy()).alias("total"))
    c = k.join(before, "part").withColumn("hi", F.col("b") + F.sum("wt").over(Window.partitionBy("part").orderBy("m"))).withColumn("lo", F.col("hi") - F.col("wt"))
    cut = c.withColumn("s", F.explode(F.expr("sequence(lo div 4096, (hi - 1) div 4096)"))).select("m", "lo", "hi", "s")
    total = parts.agg(F.sum("s").alias("total"))
    u = d.table("events").crossJoin(F.broadcast(total)).selectExpr("event_id", "(event_id * 104729) % total AS u").withColumn("s", F.expr("u div 4096"))
    return u.join(cut, "s").where("u >= lo and u < hi").select("event_id", "m")


@query("x01_scalar_parsers", "SELECT event_id, CAST((event_id % 900 + 100) * 1000 AS BIGINT) AS placements, CAST(event_id % 4096 AS BIGINT) AS mask, event_id * 1000 AS px, event_id + 7 AS py FROM events")
def x01(spark, sf_dir):
    """Counts such as 500k, hexadecimal masks and coordinates with grouping commas, parsed from text."""
    e = Design(spark, sf_dir).table("events")
    t = e.selectExpr("event_id", "concat(event_id % 900 + 100, 'k') AS c", "lower(hex(event_id % 4096)) AS hx", "concat(format_number(event_id * 1000, 0), ', ', event_id + 7) AS xy")
    number = "CASE lower(regexp_extract(c, '([kKmM]?)$', 1)) WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END"
    two = "regexp_extract_all(regexp_replace(xy, ',(?=[0-9]{3})', ''), '(-?[0-9]+)', 1)"
    return t.selectExpr("event_id", f"cast(regexp_extract(c, '^([0-9]+)', 1) as bigint) * {number} AS placements", "cast(conv(hx, 16, 10) as bigint) AS mask", f"cast({two}[0] as bigint) AS px", f"cast({two}[1] as bigint) AS py")


@query("x02_url_state", "SELECT event_id, CAST(event_id % 100 AS VARCHAR) AS x, CAST(event_id % 7 AS VARCHAR) AS z FROM events")
def x02(spark, sf_dir):
    """View state through a URL and back."""
    e = Design(spark, sf_dir).table("events")
    u = e.selectExpr("event_id", "concat('https://example.org/view?x=', event_id % 100, '&z=', event_id % 7) AS url")
    return u.selectExpr("event_id", "str_to_map(parse_url(url, 'QUERY'), '&', '=')['x'] AS x", "parse_url(url, 'QUERY', 'z') AS z")


@query("x03_name_validation", "SELECT event_id, event_id % 3 <> 0 AS valid FROM events")
def x03(spark, sf_dir):
    """Job and tile names held against their patterns."""
    e = Design(spark, sf_dir).table("events")
    return e.selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN concat('../', event_id) ELSE concat('job-', event_id) END AS name").select("event_id", F.col("name").rlike("^[a-z][a-z0-9-]{0,40}$").alias("valid"))
