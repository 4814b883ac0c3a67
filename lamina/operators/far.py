"""Far representation: density rasters and their mips, straps, clipped structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank
from ..sources.tables import DIE, Design
from .pyramid import level_kinds

BLOCK_GRID, LEAST = 32, 0.004


def far_levels(d: Design) -> list[int]:
    """The far levels; a handful of rows."""
    return sorted(r["z"] for r in level_kinds(d).where("kind = 'far'").select("z").collect())


def density_bins(d: Design, z: int) -> DataFrame:
    """bx, by, logic, fill at the raster of level z: area fractions of cells and fillers by their unrotated centre."""
    side = BLOCK_GRID << z
    p = d.placements().where("klass IN (0, 3)")
    key = lambda c, s: F.expr(f"least(greatest(((2 * {c} + {s}) * {side}L) div {2 * d.world}L, 0L), {side - 1}L)")
    area = F.expr("w * h")
    bins = p.groupBy(key("x", "w").alias("bx"), key("y", "h").alias("by")).agg(F.sum(F.when(F.col("klass") == 0, area).otherwise(0)).alias("logic"), F.sum(F.when(F.col("klass") == 3, area).otherwise(0)).alias("fill"))
    bin_area = float(d.world) / side * (float(d.world) / side)
    part = lambda c: F.least(F.lit(1.0), F.col(c).cast("double") / F.lit(bin_area))
    return bins.select("bx", "by", part("logic").alias("logic"), part("fill").alias("fill"))


def coarser(mip: DataFrame) -> DataFrame:
    """The next mip: means of two by two bins; bins that are missing count as 0."""
    return mip.groupBy(F.expr("shiftright(bx, 1)").alias("bx"), F.expr("shiftright(by, 1)").alias("by")).agg((F.sum("logic") * 0.25).alias("logic"), (F.sum("fill") * 0.25).alias("fill"))


def density_mips(d: Design) -> DataFrame:
    """z, bx, by, logic, fill of every far level."""
    levels = far_levels(d)
    finest = max(levels, default=0)
    mip, out = density_bins(d, finest), None
    for z in range(finest, -1, -1):
        here = mip.select(F.lit(z).alias("z"), "bx", "by", "logic", "fill")
        out = here if out is None else out.unionByName(here)
        mip = coarser(mip)
    return out


def density_range(mip: DataFrame) -> DataFrame:
    """lo, hi: p5 and p95 of the logic density of bins with any, to four digits."""
    some = mip.where(f"logic > {LEAST}").withColumn("one", F.lit(1))
    both = nearest_rank(some, ["one"], "logic", 5, "lo").join(nearest_rank(some, ["one"], "logic", 95, "hi"), "one")
    return both.select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def straps(d: Design) -> DataFrame:
    """axis (v or h), position, thickness, start, end of the power segments as placed."""
    p = d.placements().where("klass = 2")
    v = F.col("h") > F.col("w")
    return p.select(F.when(v, F.lit("v")).otherwise(F.lit("h")).alias("axis"), F.when(v, F.col("x")).otherwise(F.col("y")).alias("position"), F.least("w", "h").alias("thickness"), F.when(v, F.col("y")).otherwise(F.col("x")).alias("start"), F.expr("CASE WHEN h > w THEN y + h ELSE x + w END").alias("end"))


def coalesced(segments: DataFrame, width: int | None = None) -> DataFrame:
    """Touching and overlapping segments of one line merged: gaps and islands over a running end.

    A line may hold any share of the segments: it is cut into spans of width by where
    they start, each of which is swept alone with the furthest end and the number of
    islands that the spans before it carry over.
    """
    line = ["axis", "position", "thickness"]
    width = width or max(1, DIE // (16 * max(1, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    cut = segments.withColumn("span", F.expr(f"floor(start / {width})"))
    before = Window.partitionBy(*line).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # spans of a line
    inside = Window.partitionBy(*line, "span").orderBy("start", "end")
    ends = cut.groupBy(*line, "span").agg(F.max("end").alias("end")).select(*line, "span", F.max("end").over(before).alias("carried"))
    reach = F.greatest("carried", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    flagged = cut.join(ends, [*line, "span"]).withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    begun = flagged.groupBy(*line, "span").agg(F.sum("new").alias("n")).select(*line, "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("islands"))
    island = flagged.join(begun, [*line, "span"]).withColumn("island", F.col("islands") + F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*line, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("segments")).drop("island")


def structures(d: Design) -> DataFrame:
    """Boxes of macros (layer 13) and merged straps (14): layer, x0, y0, x1, y1."""
    macro = d.placements().where("klass = 1").selectExpr("13 AS layer", "x AS x0", "y AS y0", "x + CASE WHEN o IN (2, 3, 6, 7) THEN h ELSE w END AS x1", "y + CASE WHEN o IN (2, 3, 6, 7) THEN w ELSE h END AS y1")
    s = coalesced(straps(d)).selectExpr(
        "14 AS layer",
        "CASE WHEN axis = 'v' THEN position ELSE start END AS x0",
        "CASE WHEN axis = 'v' THEN start ELSE position END AS y0",
        "CASE WHEN axis = 'v' THEN position + thickness ELSE end END AS x1",
        "CASE WHEN axis = 'v' THEN end ELSE position + thickness END AS y1",
    )
    return macro.unionByName(s)


def clipped(boxes: DataFrame, tile: int, side: int) -> DataFrame:
    """Boxes cut at tile borders: one row per tile that a box covers, local coordinates, no empty ones.

    A box lists its tiles, so rows grow with the area covered and nothing is compared.
    """
    first = lambda c: F.expr(f"greatest({c} div {tile}L, 0L)")
    last = lambda c: F.expr(f"least(({c} - 1) div {tile}L, {side - 1}L)")
    own = boxes.withColumns({"a": first("x0"), "b": last("x1"), "c": first("y0"), "e": last("y1")}).where("a <= b and c <= e")
    own = own.withColumn("tx", F.explode(F.sequence("a", "b"))).withColumn("ty", F.explode(F.sequence("c", "e")))
    cut = own.selectExpr("layer", "tx", "ty", f"greatest(x0, tx * {tile}L) - tx * {tile}L AS x", f"greatest(y0, ty * {tile}L) - ty * {tile}L AS y", f"least(x1, (tx + 1) * {tile}L) - greatest(x0, tx * {tile}L) AS w", f"least(y1, (ty + 1) * {tile}L) - greatest(y0, ty * {tile}L) AS h")
    return cut.where("w > 0 and h > 0")
