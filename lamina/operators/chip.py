"""Block instances on a chip, without flattening: transforms, visibility and chip geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def point_to_block(o: Column, side: int, ix: Column, iy: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return G.to_block(o, F.lit(side), x - ix, y - iy)


def rect_to_block(o: Column, side: int, ix: Column, iy: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    """A chip rectangle in the block; it stays a rectangle."""
    ax, ay = point_to_block(o, side, ix, iy, x0, y0)
    bx, by = point_to_block(o, side, ix, iy, x1, y1)
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


def visible(instances: DataFrame, views: DataFrame, side: int) -> DataFrame:
    """Instances whose closed box meets each view (qid, x0, y0, x1, y1); instances are the few, views the many."""
    i = F.broadcast(instances.withColumnsRenamed({"x": "ix", "y": "iy", "o": "io"}))
    return views.join(i, (F.col("ix") + side >= F.col("x0")) & (F.col("ix") <= F.col("x1")) & (F.col("iy") + side >= F.col("y0")) & (F.col("iy") <= F.col("y1")))


def axis_geometry(instances: DataFrame) -> DataFrame:
    """Of each axis: distinct positions and the least gap between neighbours."""
    out = None
    for axis in ("x", "y"):
        p = instances.select(F.col(axis).alias("p")).distinct()
        gap = p.withColumn("gap", F.col("p") - F.lag("p").over(Window.orderBy("p")))
        one = gap.agg(F.lit(axis).alias("axis"), F.count(F.lit(1)).alias("positions"), F.min("gap").alias("pitch"))
        out = one if out is None else out.unionByName(one)
    return out
