"""Queries over the tile pyramid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.stats import count, nearest_rank, weighted_rank
from ..operators import pyramid as P
from ..registry import query
from ..sources.tables import Design


@query("a01_tile_counts", "SELECT tx, ty, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY ty, tx) - count(*) AS BIGINT) AS start FROM tp GROUP BY tx, ty")
def a01(spark, sf_dir):
    """Count and first position of each deepest tile, row-major."""
    tiles = P.tile_counts(Design(spark, sf_dir))
    before = Window.orderBy("ty", "tx").rowsBetween(Window.unboundedPreceding, -1)
    rows = tiles.groupBy("ty").agg(F.sum("n").alias("row_n"))
    starts = rows.select("ty", F.coalesce(F.sum("row_n").over(Window.orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("row_start"))
    inside = Window.partitionBy("ty").orderBy("tx").rowsBetween(Window.unboundedPreceding, -1)
    return tiles.join(starts, "ty").select("tx", "ty", "n", (F.col("row_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))


_COUNTS = """, lc AS (SELECT z, tx >> up AS tx, ty >> up AS ty, count(*) AS n FROM tp, lv GROUP BY ALL
), st AS (SELECT z, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS placements, list_sort(list(n)) AS l FROM lc GROUP BY z
), q AS (SELECT z, tiles, placements, l[1 + least(tiles - 1, tiles * 95 // 100)] AS p95 FROM st
), kd AS (SELECT q.*, CASE WHEN maxz - z < 2 AND least(power(4, z), 32) * p95 * mean_rc <= 2000000 THEN 0
    WHEN least(power(4, z), 32) * p95 <= 2000000 AND mean_w * 512 / (tile << (maxz - z)) >= 1.5 THEN 1 ELSE 2 END AS r FROM q, geo, means
), kinds AS (SELECT z, tiles, placements, p95, CASE max(r) OVER (ORDER BY z DESC) WHEN 0 THEN 'deep' WHEN 1 THEN 'mid' ELSE 'far' END AS kind FROM kd)
"""


@query("a02_level_counts", _COUNTS + "SELECT CAST(z AS INTEGER) AS z, tiles, placements, p95, kind FROM kinds")
def a02(spark, sf_dir):
    return P.level_kinds(Design(spark, sf_dir))


@query("a03_p95_by_kind_columns", _COUNTS + ", ov AS (SELECT z, tx >> up AS tx, ty >> up AS ty, count(*) AS n FROM tp, lv WHERE NOT 4 * greatest(w, h) > ztile GROUP BY ALL), ol AS (SELECT z, list_sort(list(n)) AS l FROM ov GROUP BY z) SELECT CAST(q.z AS INTEGER) AS z, p95, ol.l[1 + least(len(ol.l) - 1, len(ol.l) * 95 // 100)] AS kept_p95 FROM q JOIN ol ON q.z = ol.z")
def a03(spark, sf_dir):
    """p95 of placements per tile, before and after overflow promotion."""
    d = Design(spark, sf_dir)
    kept = P.level_summary(d)
    return nearest_rank(P.level_counts(d), ["z"], "n", 95, "p95").join(nearest_rank(kept, ["z"], "n", 95, "kept_p95"), "z")


_BUCKET = "CASE WHEN rc <= 4 THEN 0 WHEN rc <= 6 THEN 1 WHEN rc <= 8 THEN 2 ELSE 3 END"


@query("a05_bucket_table", f", b AS (SELECT tx, ty, {_BUCKET} AS bucket, count(*) AS n, CAST(sum(rc) AS BIGINT) AS rects FROM tp WHERE NOT 4 * greatest(w, h) > tile GROUP BY ALL) SELECT tx, ty, bucket, n, rects, CAST(sum(n) OVER (PARTITION BY tx, ty ORDER BY bucket) - n AS BIGINT) AS start FROM b")
def a05(spark, sf_dir):
    """Rect-count buckets of each deep tile: how many, their rects, and where they start."""
    d = Design(spark, sf_dir)
    rows = P.tiled(d).where(~G.oversize(F.col("w"), F.col("h"), d.tile)).withColumn("bucket", G.bucket_of(F.col("rc"), P.CAPS))
    table = rows.groupBy("tx", "ty", "bucket").agg(count().alias("n"), F.sum("rc").alias("rects"))
    before = Window.partitionBy("tx", "ty").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))


@query("p32_bucket_slices", f", b AS (SELECT tx, ty, {_BUCKET} AS bucket, count(*) AS n FROM tp WHERE NOT 4 * greatest(w, h) > tile GROUP BY ALL) SELECT tx, ty, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM b GROUP BY tx, ty")
def p32(spark, sf_dir):
    """Bucket slice descriptors of each deep tile."""
    t = a05(spark, sf_dir)
    s = F.sort_array(F.collect_list(F.struct("bucket", "n")))
    return t.groupBy("tx", "ty").agg(s.alias("s")).select("tx", "ty", F.col("s.bucket").alias("buckets"), F.col("s.n").alias("counts"))


@query("a06_content_box", "SELECT tx, ty, CAST(min(x - tx * tile) AS BIGINT) AS x0, CAST(min(y - ty * tile) AS BIGINT) AS y0, CAST(max(x - tx * tile + bw) AS BIGINT) AS x1, CAST(max(y - ty * tile + bh) AS BIGINT) AS y1 FROM tp WHERE NOT 4 * greatest(w, h) > tile GROUP BY tx, ty")
def a06(spark, sf_dir):
    """Content box of each deep tile in local coordinates."""
    d = Design(spark, sf_dir)
    t = P.tiled(d).where(~G.oversize(F.col("w"), F.col("h"), d.tile)).withColumns({"lx": F.expr(f"x - tx * {d.tile}"), "ly": F.expr(f"y - ty * {d.tile}")})
    return t.groupBy("tx", "ty").agg(F.min("lx").alias("x0"), F.min("ly").alias("y0"), F.max(F.expr("lx + bw")).alias("x1"), F.max(F.expr("ly + bh")).alias("y1"))


_LEVEL = """, lr AS (SELECT z, up, zside, ztile, tx >> up AS tx, ty >> up AS ty, x - (tx >> up) * ztile AS lx, y - (ty >> up) * ztile AS ly, bw, bh, m, o, w, h, rc, klass, pno, 4 * greatest(w, h) > ztile AS ovf FROM tp, lv)
"""


@query("a07_level_cost", _COUNTS + _LEVEL + ", c AS (SELECT z, tx, ty, sum(CASE WHEN kind = 'deep' THEN rc ELSE 1 END) AS cost FROM lr JOIN kinds USING (z) WHERE NOT ovf AND kind <> 'far' GROUP BY ALL), l AS (SELECT z, count(*) AS k, sum(cost) AS total, list_sort(list(cost)) AS l FROM c GROUP BY z) SELECT CAST(z AS INTEGER) AS z, CAST(total AS BIGINT) AS rect_total, CAST(l[1 + least(k - 1, k * 95 // 100)] AS BIGINT) AS rect_p95 FROM l")
def a07(spark, sf_dir):
    """What the tiles of each deep or mid level cost to draw, overflow excluded."""
    d = Design(spark, sf_dir)
    kinds = F.broadcast(P.level_kinds(d).where("kind <> 'far'").select("z", "kind"))
    cost = P.level_summary(d).join(kinds, "z").withColumn("cost", F.when(F.col("kind") == "deep", F.col("rects")).otherwise(F.col("n")))
    return cost.groupBy("z").agg(F.sum("cost").alias("rect_total")).join(nearest_rank(cost, ["z"], "cost", 95, "rect_p95"), "z")


@query("a08_level_stats", _LEVEL + f", t AS (SELECT z, tx, ty, sum(rc) AS rects, count(DISTINCT {_BUCKET}) AS b, max(greatest(0, lx + bw - ztile, ly + bh - ztile)) AS over FROM lr WHERE NOT ovf GROUP BY z, tx, ty) SELECT CAST(z AS INTEGER) AS z, count(*) AS tile_count, CAST(sum(rects) AS BIGINT) AS rect_total, max(b) AS max_buckets, max(over) AS max_overhang FROM t GROUP BY z")
def a08(spark, sf_dir):
    """Tiles, rects, most buckets in a tile and overhang of each level."""
    d = Design(spark, sf_dir)
    t = P.level_summary(d).withColumn("b", F.bit_count("mask").cast("long"))
    return t.groupBy("z").agg(count().alias("tile_count"), F.sum("rects").alias("rect_total"), F.max("b").alias("max_buckets"), F.max("over").alias("max_overhang"))


@query("a09_bucket_mask", f"SELECT tx, ty, bit_or(1 << {_BUCKET}) AS mask, CAST(bit_count(bit_or(1 << {_BUCKET})) AS INTEGER) AS buckets FROM tp GROUP BY tx, ty")
def a09(spark, sf_dir):
    """Which buckets a tile has, as a mask."""
    t = P.tiled(Design(spark, sf_dir)).withColumn("bucket", G.bucket_of(F.col("rc"), P.CAPS))
    return t.groupBy("tx", "ty").agg(F.bit_or(F.expr("shiftleft(1, bucket)")).alias("mask")).withColumn("buckets", F.bit_count("mask"))


@query("a10_overflow", _LEVEL + "SELECT CAST(z AS INTEGER) AS z, count(*) FILTER (WHERE ovf) AS ovf_count, CAST(coalesce(sum(rc) FILTER (WHERE ovf), 0) AS BIGINT) AS ovf_rects FROM lr GROUP BY z")
def a10(spark, sf_dir):
    """Placements promoted to each level's overflow list; a property of the master, so counted per master first."""
    d = Design(spark, sf_dir)
    by = d.placements().groupBy("w", "h", "rc").agg(count().alias("n"))
    rows = by.crossJoin(F.broadcast(P.level_table(d))).withColumn("o", F.expr("4 * greatest(w, h) > ztile"))
    return rows.groupBy("z").agg(F.sum(F.when(F.col("o"), F.col("n")).otherwise(0)).alias("ovf_count"), F.sum(F.when(F.col("o"), F.col("n") * F.col("rc")).otherwise(0)).alias("ovf_rects"))


@query("f04_oversize_masters", "SELECT m, CAST(z AS INTEGER) AS z FROM mast, lv WHERE 4 * greatest(w, h) > ztile")
def f04(spark, sf_dir):
    """Masters too large for a level's tiles."""
    d = Design(spark, sf_dir)
    return d.masters.crossJoin(F.broadcast(P.level_table(d))).where("4 * greatest(w, h) > ztile").select("m", "z")


@query("k02_tile_headers", _LEVEL + "SELECT CAST(z AS INTEGER) AS z, tx, ty, tx * ztile AS origin_x, ty * ztile AS origin_y, count(*) AS records, CAST(sum(rc) AS BIGINT) AS rects, CAST(64 + 12 * count(*) AS BIGINT) AS bytes FROM lr WHERE NOT ovf GROUP BY z, tx, ty, ztile")
def k02(spark, sf_dir):
    """One header row per tile of every level."""
    d = Design(spark, sf_dir)
    t = P.level_summary(d).withColumnRenamed("n", "records")
    return t.selectExpr("z", "tx", "ty", "tx * ztile AS origin_x", "ty * ztile AS origin_y", "records", "rects", "64 + 12 * records AS bytes")


@query("k04_deep_tiles", f"SELECT tx, ty, {_BUCKET} AS bucket, row_number() OVER (PARTITION BY tx, ty ORDER BY {_BUCKET}, pno) AS ord, x - tx * tile AS lx, y - ty * tile AS ly, m, o, pno FROM tp WHERE NOT 4 * greatest(w, h) > tile")
def k04(spark, sf_dir):
    """Records of the deepest tiles in their order: by bucket, then as placed."""
    d = Design(spark, sf_dir)
    t = P.tiled(d, True).where(~G.oversize(F.col("w"), F.col("h"), d.tile)).withColumn("bucket", G.bucket_of(F.col("rc"), P.CAPS))
    order = Window.partitionBy("tx", "ty").orderBy("bucket", "pno")
    return t.select("tx", "ty", "bucket", F.row_number().over(order).cast("long").alias("ord"), F.expr(f"x - tx * {d.tile}").alias("lx"), F.expr(f"y - ty * {d.tile}").alias("ly"), "m", "o", "pno")


@query("w03_tile_order", "SELECT tx, ty, pno, row_number() OVER (PARTITION BY tx, ty ORDER BY pno) AS ord FROM tp")
def w03(spark, sf_dir):
    """Stable order of placements inside their deepest tile."""
    t = P.tiled(Design(spark, sf_dir), True)
    return t.select("tx", "ty", "pno", F.row_number().over(Window.partitionBy("tx", "ty").orderBy("pno")).cast("long").alias("ord"))


@query("k05_mid_tiles", _COUNTS + _LEVEL + "SELECT CAST(z AS INTEGER) AS z, tx, ty, row_number() OVER (PARTITION BY z, tx, ty ORDER BY pno) AS ord, lx, ly, m, o FROM lr JOIN kinds USING (z) WHERE kind = 'mid' AND NOT ovf")
def k05(spark, sf_dir):
    """Records of the mid levels: outlines in original order."""
    d = Design(spark, sf_dir)
    rows = P.placement_rows(d, P.level_kinds(d).where("kind = 'mid'")).where("not is_overflow")
    return rows.select("z", "tx", "ty", F.row_number().over(Window.partitionBy("z", "tx", "ty").orderBy("pno")).cast("long").alias("ord"), "lx", "ly", "m", "o")


@query("k06_overflow_lists", _COUNTS + _LEVEL + "SELECT CAST(z AS INTEGER) AS z, pno, m, o, lx + tx * ztile AS x, ly + ty * ztile AS y FROM lr JOIN kinds USING (z) WHERE kind <> 'far' AND ovf")
def k06(spark, sf_dir):
    """Placements in each deep or mid level's overflow list, in world coordinates."""
    d = Design(spark, sf_dir)
    levels = P.level_kinds(d).where("kind <> 'far'").select("z").join(P.level_table(d), "z")
    # Small sides first: masters that are oversize somewhere.
    large = d.masters.crossJoin(F.broadcast(levels)).where("4 * greatest(w, h) > ztile").select("m", "z")
    return d.placements(True).select("pno", "m", "o", "x", "y").join(F.broadcast(large), "m").select("z", "pno", "m", "o", "x", "y")


@query("k10_coverage_bytes", _LEVEL + ", t AS (SELECT DISTINCT z, zside, tx, ty FROM lr) SELECT CAST(z AS INTEGER) AS z, (ty * zside + tx) // 8 AS byte_no, CAST(bit_or(CAST(1 AS BIGINT) << ((ty * zside + tx) % 8)) AS BIGINT) AS bits FROM t GROUP BY 1, 2")
def k10(spark, sf_dir):
    """Coverage bitmap of each level, as bytes that aren't zero; bit 0 comes first."""
    t = P.level_counts(Design(spark, sf_dir)).withColumn("i", F.expr("ty * shiftleft(1L, z) + tx"))
    return t.groupBy("z", F.expr("i div 8").alias("byte_no")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i % 8 as int))")).alias("bits"))


@query("s12_coverage_decode", _LEVEL + "SELECT DISTINCT CAST(z AS INTEGER) AS z, tx, ty FROM lr")
def s12(spark, sf_dir):
    """Occupied tiles, read back from the coverage bytes."""
    b = k10(spark, sf_dir).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).where("(shiftright(bits, bit) & 1) = 1")
    return b.withColumn("i", F.expr("byte_no * 8 + bit")).selectExpr("z", "i % shiftleft(1L, z) AS tx", "i div shiftleft(1L, z) AS ty")


@query("a12_usage_histograms", "SELECT 'klass' AS what, klass AS code, count(*) AS n FROM plc GROUP BY klass UNION ALL SELECT 'orient', o, count(*) FROM plc GROUP BY o")
def a12(spark, sf_dir):
    """How often each class and orientation is placed."""
    p = Design(spark, sf_dir).placements().groupBy("klass", "o").agg(count().alias("n"))
    by = lambda c, name: p.groupBy(F.col(c).alias("code")).agg(F.sum("n").alias("n")).select(F.lit(name).alias("what"), "code", "n")
    return by("klass", "klass").unionByName(by("o", "orient"))


@query("a14_rect_histogram", "SELECT rc, count(*) AS n, CAST(sum(w) AS BIGINT) AS width, count(*) / CAST((SELECT count(*) FROM plc WHERE klass IN (0, 3)) AS DOUBLE) AS weight FROM plc WHERE klass IN (0, 3) GROUP BY rc")
def a14(spark, sf_dir):
    """Rect counts of placeable cells, weighted by use."""
    p = Design(spark, sf_dir).placements().where("klass IN (0, 3)").groupBy("rc").agg(count().alias("n"), F.sum("w").alias("width"))
    total = p.agg(F.sum("n").alias("total"))
    return p.crossJoin(F.broadcast(total)).select("rc", "n", "width", (F.col("n") / F.col("total")).alias("weight"))


@query("a16_cap_cost", "SELECT CAST(sum(rc) AS BIGINT) AS actual, CAST(sum(CASE WHEN rc <= 4 THEN 4 WHEN rc <= 6 THEN 6 WHEN rc <= 8 THEN 8 ELSE 30 END) AS BIGINT) AS submitted, CAST(sum(CASE WHEN rc <= 4 THEN 4 WHEN rc <= 6 THEN 6 WHEN rc <= 8 THEN 8 ELSE 30 END) - sum(rc) AS DOUBLE) / CAST(sum(rc) AS DOUBLE) AS waste FROM plc")
def a16(spark, sf_dir):
    """Padding of bucketed drawing."""
    p = Design(spark, sf_dir).placements().groupBy("rc").agg(count().alias("n")).withColumn("cap", G.cap_of(F.col("rc"), P.CAPS))
    s = p.agg(F.sum(F.expr("n * rc")).alias("actual"), F.sum(F.expr("n * cap")).alias("submitted"))
    return s.withColumn("waste", F.expr("cast(submitted - actual as double) / cast(actual as double)"))


@query("a17_tile_masters", "SELECT tx >> 1 AS bx, ty >> 1 AS byy, count(DISTINCT m) AS masters FROM tp GROUP BY 1, 2")
def a17(spark, sf_dir):
    """Distinct masters that each set of four sibling tiles touches."""
    t = P.tiled(Design(spark, sf_dir))
    return t.groupBy(F.expr("shiftright(tx, 1)").alias("bx"), F.expr("shiftright(ty, 1)").alias("byy")).agg(F.count_distinct("m").alias("masters"))


@query("a18_weighted_percentiles", ", s AS (SELECT klass, w, count(*) AS n FROM plc GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY klass ORDER BY w) AS acc, sum(n) OVER (PARTITION BY klass) AS total FROM s) SELECT klass, min(w) AS lo, min(w) FILTER (WHERE acc >= 0.5 * total) AS p50, min(w) FILTER (WHERE acc >= 0.95 * total) AS p95, max(w) AS hi FROM c GROUP BY klass")
def a18(spark, sf_dir):
    """Percentiles of placed widths from the weighted histogram."""
    s = Design(spark, sf_dir).placements().groupBy("klass", "w").agg(count().alias("n"))
    out = s.groupBy("klass").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    for q, name in ((0.5, "p50"), (0.95, "p95")):
        out = out.join(weighted_rank(s, ["klass"], "w", "n", q, name), "klass")
    return out


_RECTS = ", rect AS (SELECT m, r, (r * w) // (rc + 1) AS x, (r * h) // (2 * rc) AS y, greatest(1, w // (rc + 1)) AS w, greatest(1, h // 2) AS h, CAST((m + r) % 12 AS INTEGER) AS layer, CAST(r % 2 AS INTEGER) AS flags FROM (SELECT *, unnest(range(0, rc)) AS r FROM mast))"


@query("a19_master_layer_rects", _RECTS + "SELECT m, layer, count(*) AS rects FROM rect GROUP BY m, layer")
def a19(spark, sf_dir):
    return Design(spark, sf_dir).rects.groupBy("m", "layer").agg(count().alias("rects"))


@query("a20_drawn_under_mask", _RECTS + ", ml AS (SELECT m, count(*) AS rects FROM rect WHERE (3276 >> layer) & 1 = 1 GROUP BY m), u AS (SELECT klass, m, count(*) AS n FROM plc GROUP BY ALL) SELECT klass, CAST(sum(n) AS BIGINT) AS placements, CAST(sum(n * rects) AS BIGINT) AS rects FROM u JOIN ml USING (m) GROUP BY klass")
def a20(spark, sf_dir):
    """Placements and rects drawn when only some layers are on, by class."""
    d = Design(spark, sf_dir)
    visible = d.rects.where("(shiftright(3276, layer) & 1) = 1").groupBy("m").agg(count().alias("rects"))
    used = d.placements().groupBy("klass", "m").agg(count().alias("n"))
    return used.join(visible, "m").groupBy("klass").agg(F.sum("n").alias("placements"), F.sum(F.expr("n * rects")).alias("rects"))


@query("a24_busiest_tile", ", c AS (SELECT ty * side + tx AS idx, count(*) AS n FROM tp GROUP BY 1) SELECT min(idx) AS idx, n FROM c WHERE n = (SELECT max(n) FROM c) GROUP BY n")
def a24(spark, sf_dir):
    """The deepest tile with most placements; of equal ones the first."""
    d = Design(spark, sf_dir)
    c = P.tile_counts(d).withColumn("idx", F.expr(f"ty * {d.side} + tx"))
    return c.agg(F.max(F.struct(F.col("n"), (-F.col("idx")).alias("neg"))).alias("k")).selectExpr("-k.neg AS idx", "k.n AS n")


@query("f21_busiest_only", _LEVEL + ", c AS (SELECT tx, ty, count(*) AS n FROM tp GROUP BY ALL), b AS (SELECT tx, ty FROM c ORDER BY n DESC, ty, tx LIMIT 1) SELECT CAST(lv.z AS INTEGER) AS z, CASE WHEN lv.z = maxz THEN 1 ELSE 0 END AS tiles, CASE WHEN lv.z = maxz THEN (SELECT count(*) FROM tp, b WHERE tp.tx = b.tx AND tp.ty = b.ty) ELSE 0 END AS records FROM lv")
def f21(spark, sf_dir):
    """A partial build: the busiest deepest tile, and every other level empty."""
    d = Design(spark, sf_dir)
    best = P.tile_counts(d).agg(F.max("n").alias("best"))
    return P.level_table(d).crossJoin(F.broadcast(best)).select("z", F.when(F.col("z") == d.max_z, 1).otherwise(0).alias("tiles"), F.when(F.col("z") == d.max_z, F.col("best")).otherwise(0).cast("long").alias("records"))


@query("a26_library_by_class", ", k AS (SELECT klass, list_sort(list(rc)) AS l, count(*) AS n, CAST(sum(rc) AS DOUBLE) / count(*) AS mean FROM mast GROUP BY klass) SELECT klass, n, l[1] AS lo, l[1 + least(n - 1, n * 50 // 100)] AS p50, l[1 + least(n - 1, n * 95 // 100)] AS p95, l[n] AS hi, mean FROM k")
def a26(spark, sf_dir):
    """Rects per master by class."""
    m = Design(spark, sf_dir).masters
    out = m.groupBy("klass").agg(count().alias("n"), F.min("rc").alias("lo"), F.max("rc").alias("hi"), (F.sum("rc").cast("double") / F.count(F.lit(1))).alias("mean"))
    for q, name in ((50, "p50"), (95, "p95")):
        out = out.join(nearest_rank(m, ["klass"], "rc", q, name), "klass")
    return out


@query("a27_level_bytes", _COUNTS + _LEVEL + f", t AS (SELECT z, kind, tx, ty, count(*) AS n, count(DISTINCT {_BUCKET}) AS b FROM lr JOIN kinds USING (z) WHERE kind <> 'far' AND NOT ovf GROUP BY ALL) SELECT CAST(z AS INTEGER) AS z, kind, count(*) AS tiles, CAST(sum(64 + 12 * n + CASE WHEN kind = 'deep' THEN 16 * b ELSE 0 END) AS BIGINT) AS bytes FROM t GROUP BY z, kind")
def a27(spark, sf_dir):
    """Bytes of each deep or mid level: headers, records and bucket tables."""
    d = Design(spark, sf_dir)
    kinds = F.broadcast(P.level_kinds(d).where("kind <> 'far'").select("z", "kind"))
    t = P.level_summary(d).join(kinds, "z").withColumn("b", F.bit_count("mask"))
    return t.groupBy("z", "kind").agg(count().alias("tiles"), F.sum(F.expr("64 + 12 * n + CASE WHEN kind = 'deep' THEN 16 * b ELSE 0 END")).alias("bytes"))


@query("a28_flattened_total", "SELECT (SELECT count(*) FROM nation) AS instances, n AS placements, (SELECT count(*) FROM nation) * n AS flattened FROM geo")
def a28(spark, sf_dir):
    d = Design(spark, sf_dir)
    return d.instances.agg(count().alias("instances")).crossJoin(d.table("lineitem").agg(count().alias("placements"))).withColumn("flattened", F.expr("instances * placements"))


@query("w04_monotone_kinds", _COUNTS + "SELECT CAST(z AS INTEGER) AS z, kind, lag(kind) OVER (ORDER BY z DESC) AS finer FROM kinds")
def w04(spark, sf_dir):
    """Each level's kind beside the next finer one's."""
    return P.level_kinds(Design(spark, sf_dir)).select("z", "kind", F.lag("kind").over(Window.orderBy(F.desc("z"))).alias("finer"))


@query("o01_tile_major_order", "SELECT pno, row_number() OVER (ORDER BY ty, tx, pno) AS position FROM tp")
def o01(spark, sf_dir):
    """Global tile-major order of placements: positions inside tiles, shifted by the tiles' starts."""
    starts = a01(spark, sf_dir).select("tx", "ty", "start")
    t = P.tiled(Design(spark, sf_dir), True).select("tx", "ty", "pno").withColumn("ord", F.row_number().over(Window.partitionBy("tx", "ty").orderBy("pno")))
    return t.join(starts, ["tx", "ty"]).select("pno", F.expr("start + ord").alias("position"))


@query("u01_partition_of_placements", _LEVEL + "SELECT CAST(z AS INTEGER) AS z, count(*) AS placements, CAST((SELECT n FROM geo) - count(DISTINCT pno) AS BIGINT) AS lost, count(*) - count(DISTINCT pno) AS doubled, CAST(0 AS BIGINT) AS strange FROM lr GROUP BY z")
def u01(spark, sf_dir):
    """Tiles and overflow list of a level against the placements: held, lost, held more than once, not placed."""
    d = Design(spark, sf_dir)
    held = P.level_rows(d, True).groupBy("z", "pno").agg(count().alias("k"))
    want = d.placements(True).select("pno", F.explode(F.sequence(F.lit(0), F.lit(d.max_z))).alias("z"), F.lit(True).alias("placed"))
    both = held.join(want, ["z", "pno"], "full")
    return both.groupBy("z").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("placements"), F.count_if(F.col("k").isNull()).alias("lost"), F.coalesce(F.sum(F.expr("greatest(k - 1, 0L)")), F.lit(0)).alias("doubled"), F.count_if(F.col("placed").isNull()).alias("strange"))
