"""Queries over far tiles: density, straps and clipped structures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import count
from ..operators import far
from ..registry import query
from ..sources.tables import Design
from .pyramid_queries import _COUNTS

_DEN = _COUNTS + """, fz AS (SELECT max(z) AS z FROM kinds WHERE kind = 'far'
), rs AS (SELECT CAST(32 AS BIGINT) << z AS rside, z AS zf FROM fz
), bins AS (
  SELECT least(greatest(((2 * x + w) * rside) // (2 * world), 0), rside - 1) AS bx, least(greatest(((2 * y + h) * rside) // (2 * world), 0), rside - 1) AS byy,
    sum(CASE WHEN klass = 0 THEN w * h ELSE 0 END) AS la, sum(CASE WHEN klass = 3 THEN w * h ELSE 0 END) AS fa
  FROM plc, geo, rs WHERE klass IN (0, 3) GROUP BY 1, 2
), den AS (
  SELECT bx, byy AS "by", least(1.0, CAST(la AS DOUBLE) / ((CAST(world AS DOUBLE) / rside) * (CAST(world AS DOUBLE) / rside))) AS logic, least(1.0, CAST(fa AS DOUBLE) / ((CAST(world AS DOUBLE) / rside) * (CAST(world AS DOUBLE) / rside))) AS fill
  FROM bins, geo, rs
)
"""


@query("a11_density_bins", _DEN + 'SELECT bx, "by", logic, fill FROM den')
def a11(spark, sf_dir):
    """Area fractions of cells and fillers over the finest far raster."""
    d = Design(spark, sf_dir)
    return far.density_bins(d, max(far.far_levels(d), default=0))


@query("a13_density_mips", _DEN + """, mips AS (
  SELECT zf AS z, bx, "by", logic, fill FROM den, rs
  UNION ALL SELECT CAST(zf - k AS BIGINT), bx, "by", logic, fill FROM (
    SELECT k, bx >> k AS bx, "by" >> k AS "by", sum(logic) / power(4, k) AS logic, sum(fill) / power(4, k) AS fill FROM den, (SELECT unnest(range(1, 12)) AS k), rs WHERE k <= zf GROUP BY 1, 2, 3), rs)
SELECT CAST(z AS INTEGER) AS z, bx, "by", round(logic, 9) AS logic, round(fill, 9) AS fill FROM mips""")
def a13(spark, sf_dir):
    """Density mips of every far level."""
    return far.density_mips(Design(spark, sf_dir)).select("z", "bx", "by", F.round("logic", 9).alias("logic"), F.round("fill", 9).alias("fill"))


@query("a04_density_range", _DEN + ", l AS (SELECT list_sort(list(logic)) AS l, count(*) AS n FROM den WHERE logic > 0.004) SELECT round(l[1 + least(n - 1, n * 5 // 100)], 4) AS lo, round(l[1 + least(n - 1, n * 95 // 100)], 4) AS hi FROM l")
def a04(spark, sf_dir):
    d = Design(spark, sf_dir)
    return far.density_range(far.density_bins(d, max(far.far_levels(d), default=0)))


@query("f06_far_blocks", _DEN + """SELECT bx // 32 AS tx, "by" // 32 AS ty, CAST(floor(bx * CAST(world AS DOUBLE) / rside + 0.5) AS BIGINT) AS x0, CAST(floor((bx + 1) * CAST(world AS DOUBLE) / rside + 0.5) AS BIGINT) AS x1, logic, fill
FROM den, geo, rs WHERE logic + fill >= 0.004 AND logic < 0.5""")
def f06(spark, sf_dir):
    """Density blocks that are kept and less than half full, with their edges (P15)."""
    d = Design(spark, sf_dir)
    z = max(far.far_levels(d), default=0)
    edge = lambda c: f"cast(floor({c} * cast({d.world} as double) / {32 << z} + 0.5D) as bigint)"
    return far.density_bins(d, z).where("logic + fill >= 0.004 and logic < 0.5").selectExpr("bx div 32 AS tx", "by div 32 AS ty", f"{edge('bx')} AS x0", f"{edge('(bx + 1)')} AS x1", "logic", "fill")


@query("f05_density_eligible", "SELECT klass, count(*) AS n, CAST(sum(w * h) AS BIGINT) AS area FROM plc WHERE klass IN (0, 3) GROUP BY klass")
def f05(spark, sf_dir):
    return Design(spark, sf_dir).placements().where("klass IN (0, 3)").groupBy("klass").agg(count().alias("n"), F.sum(F.expr("w * h")).alias("area"))


_STRAPS = """, seg AS (SELECT CASE WHEN h > w THEN 'v' ELSE 'h' END AS axis, CASE WHEN h > w THEN x ELSE y END AS position, least(w, h) AS thickness, CASE WHEN h > w THEN y ELSE x END AS s, CASE WHEN h > w THEN y + h ELSE x + w END AS e FROM plc WHERE klass = 2
), fl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY axis, position, thickness ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM seg
), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY axis, position, thickness ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM fl
), strap AS (SELECT axis, position, thickness, min(s) AS s, max(e) AS e, count(*) AS segments FROM isl GROUP BY axis, position, thickness, island)
"""


@query("w02_strap_coalesce", _STRAPS + 'SELECT axis, position, thickness, s AS start, e AS "end", segments FROM strap')
def w02(spark, sf_dir):
    """Power straps with touching segments merged."""
    return far.coalesced(far.straps(Design(spark, sf_dir)))


_BOXES = _STRAPS + _COUNTS + """, bx AS (SELECT 13 AS layer, x AS x0, y AS y0, x + CASE WHEN o IN (2, 3, 6, 7) THEN h ELSE w END AS x1, y + CASE WHEN o IN (2, 3, 6, 7) THEN w ELSE h END AS y1 FROM plc WHERE klass = 1
  UNION ALL SELECT 14, CASE WHEN axis = 'v' THEN position ELSE s END, CASE WHEN axis = 'v' THEN s ELSE position END, CASE WHEN axis = 'v' THEN position + thickness ELSE e END, CASE WHEN axis = 'v' THEN e ELSE position + thickness END FROM strap
), t AS (SELECT tile << (maxz - (SELECT max(z) FROM kinds WHERE kind = 'far')) AS s, CAST(1 AS BIGINT) << (SELECT max(z) FROM kinds WHERE kind = 'far') AS n FROM geo
), grid AS (SELECT i, j, s FROM t, (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j) WHERE i < n AND j < n
), clip AS (SELECT layer, i AS tx, j AS ty, greatest(x0, i * s) - i * s AS x, greatest(y0, j * s) - j * s AS y, least(x1, (i + 1) * s) - greatest(x0, i * s) AS w, least(y1, (j + 1) * s) - greatest(y0, j * s) AS h FROM bx, grid WHERE x0 < (i + 1) * s AND x1 > i * s AND y0 < (j + 1) * s AND y1 > j * s)
"""


@query("j10_structures_by_tile", _BOXES + "SELECT layer, tx, ty, x, y, w, h FROM clip")
def j10(spark, sf_dir):
    """Macros and straps clipped to the tiles of the finest far level."""
    d = Design(spark, sf_dir)
    z = max(far.far_levels(d), default=0)
    return far.clipped(far.structures(d), d.tile << (d.max_z - z), 1 << z)


@query("a21_far_blocks_by_layer", _BOXES + "SELECT layer, count(*) AS blocks, CAST(sum(w * h) AS BIGINT) AS area FROM clip GROUP BY layer")
def a21(spark, sf_dir):
    """Structure rows of the far tiles by layer."""
    return j10(spark, sf_dir).groupBy("layer").agg(count().alias("blocks"), F.sum(F.expr("w * h")).alias("area"))


@query("k07_far_tile_rows", _BOXES + "SELECT tx, ty, layer, count(*) AS rows_, CAST(min(x) AS BIGINT) AS x0, CAST(max(x + w) AS BIGINT) AS x1 FROM clip GROUP BY tx, ty, layer")
def k07(spark, sf_dir):
    """Structure rows of each far tile and their extent."""
    return j10(spark, sf_dir).groupBy("tx", "ty", "layer").agg(count().alias("rows_"), F.min("x").alias("x0"), F.max(F.expr("x + w")).alias("x1"))


@query("p21_density_colour", _DEN + """, l AS (SELECT list_sort(list(logic)) AS l, count(*) AS n FROM den WHERE logic > 0.004), r AS (SELECT round(l[1 + least(n - 1, n * 5 // 100)], 4) AS lo, round(l[1 + least(n - 1, n * 95 // 100)], 4) AS hi FROM l)
SELECT bx, "by", least(greatest((logic - lo) / greatest(0.0001, hi - lo), 0), 1) AS colour, CASE WHEN logic + fill > 0 THEN fill / (logic + fill) END AS dead FROM den, r""")
def p21(spark, sf_dir):
    """Position of each block on the density scale, and the share of fillers in it."""
    bins = a11(spark, sf_dir)
    r = far.density_range(bins)
    return bins.crossJoin(F.broadcast(r)).selectExpr("bx", "by", "least(greatest((logic - lo) / greatest(0.0001D, hi - lo), 0D), 1D) AS colour", "try_divide(fill, logic + fill) AS dead")


@query("g02_sample_points", _DEN + """, b AS (SELECT bx, "by", row_number() OVER (ORDER BY "by", bx) - 1 AS i, count(*) OVER () AS n FROM den WHERE logic + fill >= 0.004) SELECT bx, "by", CAST(floor((2 * bx + 1) * CAST(world AS DOUBLE) / (2 * rside)) AS BIGINT) AS cx FROM b, geo, rs WHERE i % greatest(1, b.n // 100) = 0""")
def g02(spark, sf_dir):
    """Every so many-th kept block's centre, about a hundred of them; blocks are bounded by the raster."""
    d = Design(spark, sf_dir)
    z = max(far.far_levels(d), default=0)
    b = far.density_bins(d, z).where("logic + fill >= 0.004")
    rows = b.groupBy("by").agg(F.count(F.lit(1)).alias("k"))
    before = rows.select("by", F.coalesce(F.sum("k").over(Window.orderBy("by").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.sum("k").over(Window.partitionBy()).alias("n"))
    i = F.col("s") + F.row_number().over(Window.partitionBy("by").orderBy("bx")) - 1
    return b.join(before, "by").withColumn("i", i).where("i % greatest(1, n div 100) = 0").selectExpr("bx", "by", f"cast(floor((2 * bx + 1) * cast({d.world} as double) / {2 * (32 << z)}) as bigint) AS cx")
