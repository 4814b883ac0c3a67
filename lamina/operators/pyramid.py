"""The tile pyramid: counts, kinds, overflow, buckets and costs of every level.

Placements are aggregated once at the deepest tiles; coarser levels re-aggregate
those few rows by shifted keys, never the placements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.stats import count
from ..sources.tables import Design

RECT_BUDGET, VIS_TILES, TILE_PX, MIN_CELL_PX, MAX_DEEP = 2_000_000, 32, 512, 1.5, 2
#: Caps of the rect-count buckets where none are derived.
CAPS = [4, 6, 8, 30]


def tiled(d: Design, numbers: bool = False) -> DataFrame:
    """Placements with their deepest tile (tx, ty) and oriented box (bw, bh)."""
    p = d.placements(numbers)
    o, w, h = F.col("o"), F.col("w"), F.col("h")
    return p.withColumns({"tx": G.tile_key("x", d.tile, d.side), "ty": G.tile_key("y", d.tile, d.side), "bw": G.box_w(o, w, h), "bh": G.box_h(o, w, h)})


def level_table(d: Design) -> DataFrame:
    """z, up (levels to the deepest), zside, ztile."""
    return d.spark.createDataFrame([(z, d.max_z - z, 1 << z, d.tile << (d.max_z - z)) for z in range(d.max_z + 1)], "z int, up int, zside long, ztile long")


def exploded(tiles: DataFrame, d: Design) -> DataFrame:
    """Each deepest-tile row once for each level z, with its ancestor's key."""
    up = F.lit(d.max_z) - F.col("z")
    rows = tiles.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(d.max_z))))
    return rows.withColumns({"tx": F.expr(f"shiftright(tx, {d.max_z} - z)"), "ty": F.expr(f"shiftright(ty, {d.max_z} - z)")})


def tile_counts(d: Design) -> DataFrame:
    return tiled(d).groupBy("tx", "ty").agg(count().alias("n"))


def level_counts(d: Design) -> DataFrame:
    """z, tx, ty, n of all occupied tiles."""
    return exploded(tile_counts(d), d).groupBy("z", "tx", "ty").agg(F.sum("n").alias("n"))


def level_kinds(d: Design) -> DataFrame:
    """z, tiles, placements, p95, kind: the representation that each level's cost allows, never finer than a deeper one's."""
    # Tiles by their count: all that a level's statistics need, in one pass.
    by = level_counts(d).groupBy("z", "n").agg(count().alias("c"))
    up = Window.partitionBy("z").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("z")
    by = by.withColumns({"cum": F.sum("c").over(up), "tiles": F.sum("c").over(every), "placements": F.sum(F.col("c") * F.col("n")).over(every)})
    stats = by.where("cum > least(tiles - 1, tiles * 95 div 100)").groupBy("z").agg(F.min("n").alias("p95"), F.max("tiles").alias("tiles"), F.max("placements").alias("placements"))
    mean = d.placements().where("klass IN (0, 3)").agg((F.sum("w") / F.count(F.lit(1))).alias("mean_w"), (F.sum("rc") / F.count(F.lit(1))).alias("mean_rc"))
    stats = stats.crossJoin(F.broadcast(mean))
    seen = F.least(F.pow(F.lit(4.0), F.col("z")), F.lit(float(VIS_TILES)))
    cell_px = F.coalesce("mean_w", F.lit(1.0)) * TILE_PX / F.expr(f"cast({d.tile}L * shiftleft(1L, {d.max_z} - z) as double)")
    deep = (F.lit(d.max_z) - F.col("z") < MAX_DEEP) & (seen * F.col("p95") * F.coalesce("mean_rc", F.lit(1.0)) <= RECT_BUDGET)
    rank = F.when(deep, 0).when((seen * F.col("p95") <= RECT_BUDGET) & (cell_px >= MIN_CELL_PX), 1).otherwise(2)
    # One row per level: fifteen or so.
    down = Window.orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = stats.withColumn("rank", F.max(rank).over(down))
    kind = F.element_at(F.array(F.lit("deep"), F.lit("mid"), F.lit("far")), F.col("rank") + 1)
    return ranked.select("z", "tiles", "placements", "p95", kind.alias("kind"))


def level_rows(d: Design, numbers: bool = False) -> DataFrame:
    """Placements at every level with local coordinates lx, ly, ztile and whether they are promoted to the level's overflow list."""
    rows = exploded(tiled(d, numbers), d).withColumn("ztile", F.expr(f"{d.tile}L * shiftleft(1L, {d.max_z} - z)"))
    return rows.withColumns({"lx": F.expr("x - tx * ztile"), "ly": F.expr("y - ty * ztile"), "is_overflow": F.expr("4 * greatest(w, h) > ztile")})


def placement_rows(d: Design, kinds: DataFrame | None = None) -> DataFrame:
    """z, tx, ty, is_overflow, bucket (-1 on mid levels), pno, lx, ly, m, o, rc, bw, bh of all deep and mid levels.

    Only these levels' rows are made: a level's number decides before placements are repeated.
    """
    levels = {r["z"]: r["kind"] for r in (kinds if kinds is not None else level_kinds(d)).where("kind <> 'far'").select("z", "kind").collect()}
    deep = [z for z, k in levels.items() if k == "deep"]
    at = F.array(*(F.lit(z) for z in sorted(levels))) if levels else F.array().cast("array<int>")
    t = tiled(d, True).withColumn("z", F.explode(at)).withColumn("ztile", F.expr(f"{d.tile}L * shiftleft(1L, {d.max_z} - z)"))
    t = t.withColumns({"tx": F.expr(f"shiftright(tx, {d.max_z} - z)"), "ty": F.expr(f"shiftright(ty, {d.max_z} - z)"), "is_overflow": F.expr("4 * greatest(w, h) > ztile")})
    bucket = F.when(F.col("z").isin(deep), G.bucket_of(F.col("rc"), CAPS)).otherwise(-1)
    local = lambda c: F.expr(f"if(is_overflow, {c}, {c} - t{c} * ztile)")
    return t.select("z", "tx", "ty", "is_overflow", bucket.alias("bucket"), "pno", local("x").alias("lx"), local("y").alias("ly"), "m", "o", "rc", "bw", "bh")


def tile_summary(d: Design) -> DataFrame:
    """Deepest tiles by the levels that their content is promoted from: everything that costs a level, without its rows.

    u is how many levels up a placement has to go until it isn't oversize there.
    Counts, rects, bucket masks and extents of coarser tiles follow from these
    few rows, so planning costs one aggregation of the placements.
    """
    size = 4 * F.greatest("w", "h")
    u = F.lit(d.max_z + 1)
    for k in range(d.max_z, -1, -1):
        u = F.when(size <= F.lit(d.tile << k), F.lit(k)).otherwise(u)
    t = tiled(d).withColumns({"u": u, "bucket": G.bucket_of(F.col("rc"), CAPS)})
    return t.groupBy("tx", "ty", "u").agg(
        count().alias("n"),
        F.sum("rc").alias("rects"),
        F.bit_or(F.expr("shiftleft(1, bucket)")).alias("mask"),
        F.max(F.expr("x + bw")).alias("x1"),
        F.max(F.expr("y + bh")).alias("y1"),
    )


def level_summary(d: Design) -> DataFrame:
    """z, tx, ty, ztile, n, rects, mask, over: tiles of every level without their overflow; over is the overhang."""
    rows = exploded(tile_summary(d), d).where(f"u <= {d.max_z} - z")
    g = rows.groupBy("z", "tx", "ty").agg(F.sum("n").alias("n"), F.sum("rects").alias("rects"), F.bit_or("mask").alias("mask"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    g = g.withColumn("ztile", F.expr(f"{d.tile}L * shiftleft(1L, {d.max_z} - z)"))
    return g.withColumn("over", F.expr("greatest(0L, x1 - (tx + 1) * ztile, y1 - (ty + 1) * ztile)")).drop("x1", "y1")
