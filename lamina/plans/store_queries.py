"""Queries of stores: tile tables, manifests, regions made on demand, and rails."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import count
from ..operators import far, prefix
from ..operators import pyramid as P
from ..operators import view
from ..registry import query
from ..sources import store
from ..sources.tables import Design
from .far_queries import _DEN
from .pyramid_queries import _COUNTS, _LEVEL, _RECTS
from .view_queries import _PICKS, _VIEWS, _culled, _existing, _ranges, _views, _wanted

_ROWS = _COUNTS + _LEVEL + "SELECT CAST(z AS INTEGER) AS z, CASE WHEN NOT ovf THEN tx END AS tx, CASE WHEN NOT ovf THEN ty END AS ty, ovf AS is_overflow, CASE WHEN kind = 'deep' THEN CASE WHEN rc <= 4 THEN 0 WHEN rc <= 6 THEN 1 WHEN rc <= 8 THEN 2 ELSE 3 END END AS bucket, pno, CASE WHEN ovf THEN lx + tx * ztile ELSE lx END AS lx, CASE WHEN ovf THEN ly + ty * ztile ELSE ly END AS ly, m, o FROM lr JOIN kinds USING (z) WHERE kind <> 'far'"


@query("k08_level_write_rows", _ROWS)
def k08(spark, sf_dir):
    """All rows that a build writes."""
    return store.tile_rows(Design(spark, sf_dir))


@query("k12_materialise_region", _LEVEL + "SELECT CAST(z AS INTEGER) AS z, tx, ty, count(*) AS records, CAST(sum(rc) AS BIGINT) AS rects FROM lr WHERE z = maxz_ AND tx < 4 AND ty < 4 AND NOT ovf GROUP BY z, tx, ty".replace("maxz_", "(SELECT maxz FROM geo)"))
def k12(spark, sf_dir):
    """A region of the deepest level, made on demand (S10): the filter reaches the key before anything is grouped."""
    d = Design(spark, sf_dir)
    t = P.tiled(d).where("tx < 4 and ty < 4").where(f"not 4 * greatest(w, h) > {d.tile}")
    return t.groupBy(F.lit(d.max_z).alias("z"), "tx", "ty").agg(count().alias("records"), F.sum("rc").alias("rects"))


@query("s06_tile_read", _LEVEL + "SELECT pno, lx, ly, m, o FROM lr WHERE z = (SELECT maxz FROM geo) AND tx = 1 AND ty = 2 AND NOT ovf")
def s06(spark, sf_dir):
    """One tile's records."""
    d = Design(spark, sf_dir)
    t = P.tiled(d, True).where("tx = 1 and ty = 2").where(f"not 4 * greatest(w, h) > {d.tile}")
    return t.selectExpr("pno", f"x - tx * {d.tile} AS lx", f"y - ty * {d.tile} AS ly", "m", "o")


@query("k01_master_table", _RECTS + ", s AS (SELECT m, CAST(sum(count(*)) OVER (ORDER BY m) - count(*) AS BIGINT) AS rect_start, count(*) AS rect_count FROM rect GROUP BY m) SELECT mast.m, rect_start, rect_count, w, h, klass FROM mast JOIN s USING (m)")
def k01(spark, sf_dir):
    """Master table with where each one's rects start (S5)."""
    d = Design(spark, sf_dir)
    by = d.masters.withColumn("part", F.expr("m div 4096"))
    parts = by.groupBy("part").agg(F.sum("rc").alias("s"))
    before = parts.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    inside = F.coalesce(F.sum("rc").over(Window.partitionBy("part").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by.join(before, "part").select("m", (F.col("b") + inside).alias("rect_start"), F.col("rc").alias("rect_count"), "w", "h", "klass")


@query("k11b_manifest_round_trip", _COUNTS + "SELECT CAST(maxz AS INTEGER) AS max_z, tile, world, n AS placements, (SELECT count(*) FROM kinds) AS levels, (SELECT count(*) FROM kinds WHERE kind = 'far') AS far FROM geo")
def k11b(spark, sf_dir):
    """The manifest as JSON, read back."""
    m = store.read_manifest(store.manifest(Design(spark, sf_dir)))
    return m.select("max_z", "tile", "world", "placements", F.size("levels").cast("long").alias("levels"), F.size(F.filter("levels", lambda x: x["kind"] == "far")).cast("long").alias("far"))


@query("f10_half_open", _PICKS + "SELECT count(*) AS hits, count(*) FILTER (WHERE cx = x OR cy = y) AS low_edges, 0::BIGINT AS high_edges FROM hit JOIN pk USING (qid)")
def f10(spark, sf_dir):
    """Hits on low edges count, on high edges don't."""
    d = Design(spark, sf_dir)
    # Points of one number meet each other.
    own = d.picks.groupBy("qid", "cx", "cy").agg(count().alias("n"))
    h = view.hits(d, own, "cx", "cy", "n")
    times = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.expr("n * n"))), F.lit(0).cast("long"))
    return h.agg(times("true").alias("hits"), times("cx = x or cy = y").alias("low_edges"), times("cx = x + bw or cy = y + bh").alias("high_edges"))


@query("f11_resident_only", _VIEWS + "SELECT qid, i, tx, ty FROM cull WHERE (tx + ty) % 3 = 0")
def f11(spark, sf_dir):
    """Visible tiles that are resident."""
    d = Design(spark, sf_dir)
    return _culled(d, "(tx + ty) % 3 = 0")


@query("o04_first_instance", _VIEWS + "SELECT qid, min(i) AS i FROM cull GROUP BY qid")
def o04(spark, sf_dir):
    """The first instance, in chip order, that shows anything to each view."""
    d = Design(spark, sf_dir)
    return prefix.not_empty(_ranges(d), _existing(d)).groupBy("qid").agg(F.min("i").alias("i"))


@query("o05_first_density_block", _DEN + """, pk AS (SELECT event_id AS qid, (event_id * 7919) % 2500000 AS cx, (event_id * 104729) % 2500000 AS cy FROM events) SELECT qid, min("by" * rside + bx) AS block FROM pk JOIN den ON bx = cx * (SELECT max(rside) FROM rs) // (SELECT world FROM geo) AND "by" = cy * (SELECT max(rside) FROM rs) // (SELECT world FROM geo), rs WHERE logic + fill >= 0.004 GROUP BY qid""")
def o05(spark, sf_dir):
    """Density block under each point at the far levels."""
    d = Design(spark, sf_dir)
    z = max(far.far_levels(d), default=0)
    side = 32 << z
    b = far.density_bins(d, z).where("logic + fill >= 0.004").select("bx", "by")
    p = d.picks.selectExpr("qid", f"cx * {side} div {d.world}L AS bx", f"cy * {side} div {d.world}L AS by")
    return p.join(b, ["bx", "by"]).groupBy("qid").agg(F.min(F.expr(f"by * {side} + bx")).alias("block"))


@query("o07_rails", _VIEWS + "SELECT qid, tx, ty FROM (SELECT DISTINCT qid, tx, ty FROM cull) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ty, tx) <= 8")
def o07(spark, sf_dir):
    """At most eight tiles of each view."""
    d = Design(spark, sf_dir)
    return prefix.first_existing(_ranges(d), "qid", _existing(d), d.side, 8)


@query("k13_disk_cache", _VIEWS + ", t AS (SELECT tx, ty, max(qid) AS used, count(*) AS n FROM cull GROUP BY tx, ty), b AS (SELECT t.tx, t.ty, used, 64 + 12 * c.n AS bytes FROM t JOIN (SELECT tx, ty, count(*) AS n FROM tp GROUP BY ALL) c USING (tx, ty)), r AS (SELECT *, sum(bytes) OVER (ORDER BY used DESC, ty, tx) AS held FROM b) SELECT tx, ty, CAST(held AS BIGINT) AS held FROM r WHERE held <= 300000")
def k13(spark, sf_dir):
    """Tiles that a disk cache of a byte budget keeps, most recently used first."""
    d = Design(spark, sf_dir)
    used = prefix.most_over(_ranges(d).withColumnRenamed("qid", "used"), "used")
    b = used.join(P.tile_counts(d), ["tx", "ty"]).withColumn("bytes", F.expr("64 + 12 * n"))
    # No tile has less than 64 bytes, so no more tiles than this can be held.
    first = b.orderBy(F.desc("used"), "ty", "tx").limit(300_000 // 64)
    held = F.sum("bytes").over(Window.orderBy(F.desc("used"), "ty", "tx").rowsBetween(Window.unboundedPreceding, 0))
    return first.select("tx", "ty", held.alias("held")).where("held <= 300000")


@query("k14_tile_metrics", _VIEWS + "SELECT i, count(*) AS requests, count(DISTINCT (tx, ty)) AS tiles FROM cull GROUP BY i")
def k14(spark, sf_dir):
    """Tile requests by instance."""
    return _wanted(Design(spark, sf_dir), "i", "i").groupBy("i").agg(F.sum("n").alias("requests"), count().alias("tiles"))


@query("k15_view_state", _VIEWS + "SELECT qid, x0, y0 FROM vw")
def k15(spark, sf_dir):
    """Views through their URL and back."""
    v = _views(Design(spark, sf_dir)).selectExpr("qid", "concat('https://example.org/?x=', x0, '&y=', y0) AS url")
    return v.selectExpr("qid", "cast(parse_url(url, 'QUERY', 'x') as bigint) AS x0", "cast(parse_url(url, 'QUERY', 'y') as bigint) AS y0")


@query("p16_clip_boxes", ", b AS (SELECT pno, x, y, x + bw AS x1, y + bh AS y1, tile FROM tp WHERE klass = 1), c AS (SELECT pno, least(x1, (x // tile + 1) * tile) - x AS w, least(y1, (y // tile + 1) * tile) - y AS h FROM b) SELECT pno, w, h FROM c WHERE w > 0 AND h > 0")
def p16(spark, sf_dir):
    """Macros clipped to the tile that they start in."""
    d = Design(spark, sf_dir)
    b = P.tiled(d, True).where("klass = 1")
    t = d.tile
    return b.selectExpr("pno", f"least(x + bw, (x div {t} + 1) * {t}) - x AS w", f"least(y + bh, (y div {t} + 1) * {t}) - y AS h").where("w > 0 and h > 0")


@query("s09_design_catalog", "SELECT r_name AS name, count(*) AS files, CAST(sum(length(n_name)) AS BIGINT) AS bytes FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def s09(spark, sf_dir):
    """A catalog of designs and their files' bytes, from a listing."""
    d = Design(spark, sf_dir)
    files = d.table("region").join(d.table("nation"), F.expr("r_regionkey = n_regionkey")).selectExpr("r_name AS name", "cast(length(n_name) as bigint) AS bytes")
    return files.groupBy("name").agg(count().alias("files"), F.sum("bytes").alias("bytes"))
