"""The layout model over the star-schema tables: masters, rects, placements, instances and picks.

Masters come from part, placements from lineitem, block instances from nation
and pick points from events; every column is integer arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Side of the square die, site width, strap pitch, placements that a deepest tile should hold.
DIE, SITE, PITCH, PER_TILE = 2_512_000, 200, 50_000, 256


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m, klass (0 STD, 1 MACRO, 2 PWR, 3 FILL), w, h, rc."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS m",
        "CASE WHEN p_type = 'LARGE' AND p_size >= 49 THEN 1 WHEN p_type = 'SMALL' AND p_size IN (1, 2) THEN 2 WHEN p_type = 'ECONOMY' THEN 3 ELSE 0 END AS klass",
        "CAST(CASE WHEN p_type = 'LARGE' AND p_size >= 49 THEN p_size * 4000 WHEN p_type = 'SMALL' AND p_size = 1 THEN 800 WHEN p_type = 'SMALL' AND p_size = 2 THEN 25000 ELSE (2 + p_size % 19) * 200 END AS BIGINT) AS w",
        "CAST(CASE WHEN p_type = 'LARGE' AND p_size >= 49 THEN p_size * 2000 WHEN p_type = 'SMALL' AND p_size = 1 THEN 25000 WHEN p_type = 'SMALL' AND p_size = 2 THEN 800 ELSE 1000 END AS BIGINT) AS h",
        "CAST(CASE WHEN p_type = 'LARGE' AND p_size >= 49 THEN 30 WHEN p_type = 'SMALL' AND p_size IN (1, 2) THEN 1 WHEN p_type = 'ECONOMY' THEN 3 ELSE 3 + p_size % 6 END AS BIGINT) AS rc",
    )


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def numbered(df: DataFrame, order: tuple[str, ...], out: str, parts: int) -> DataFrame:
    """1-based position in a total order of which the first column is a number.

    Equal spans of the first column are numbered alone and shifted by the running
    sum of the spans' counts, so no task sees all rows. Spans are cut by value
    and not by a sample: both uses of them agree, however often they are computed.
    """
    lo, hi = df.agg(F.min(order[0]), F.max(order[0])).first()
    if lo is None:
        return df.withColumn(out, F.lit(0).cast("long"))
    width = max(1, -(-(int(hi) - int(lo) + 1) // (parts * 16)))
    ranged = df.withColumn("_span", F.expr(f"(`{order[0]}` - {int(lo)}) div {width}"))
    sizes = ranged.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_span").orderBy(*order)
    return ranged.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(starts), "_span").withColumn(out, F.col("_start") + F.col("_row")).drop("_span", "_row", "_start")


@dataclass
class Design:
    """A layout: its DataFrames and pyramid geometry."""

    spark: SparkSession
    sf_dir: str
    per_tile: int = PER_TILE

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def masters(self) -> DataFrame:
        return masters(self.spark, self.sf_dir)

    @cached_property
    def rects(self) -> DataFrame:
        """m, r, x, y, w, h, layer, flags: rc rectangles of each master, inside its box."""
        r = self.masters.select("m", "w", "h", "rc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rc") - 1)).alias("r"))
        return r.selectExpr("m", "r", "(r * w) div (rc + 1) AS x", "(r * h) div (2 * rc) AS y", "greatest(1L, w div (rc + 1)) AS w", "greatest(1L, h div 2) AS h", "CAST((m + r) % 12 AS INT) AS layer", "CAST(r % 2 AS INT) AS flags")

    def placements(self, numbers: bool = False) -> DataFrame:
        """m, o, x, y, klass, w, h, rc and, on demand, pno: the original order."""
        lines = self.table("lineitem")
        if numbers:
            lines = numbered(lines, ORDER, "pno", max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        raw = lines.selectExpr(
            "l_partkey AS m",
            "CAST((l_orderkey + l_linenumber) % 8 AS INT) AS o",
            "CAST(datediff(l_shipdate, DATE'1995-01-01') AS BIGINT) * 1000 + (l_linenumber % 5) * 200 AS x0",
            "(CAST(round(l_extendedprice * 100) AS BIGINT) div 4200) * 1000 AS y0",
            *(["CAST(pno AS BIGINT) AS pno"] if numbers else []),
        )
        # Straps stand on their pitch, across their direction.
        p = raw.join(self.masters, "m")
        x = F.expr(f"CASE WHEN klass = 2 AND h > w THEN (x0 div {PITCH}) * {PITCH} ELSE x0 END")
        y = F.expr(f"CASE WHEN klass = 2 AND w > h THEN (y0 div {PITCH}) * {PITCH} ELSE y0 END")
        return p.select(*(["pno"] if numbers else []), "m", "o", x.alias("x"), y.alias("y"), "klass", "w", "h", "rc")

    @cached_property
    def n(self) -> int:
        return self.table("lineitem").count()

    @cached_property
    def max_z(self) -> int:
        """The level whose tiles hold about per_tile placements each."""
        return max(0, math.ceil(math.log2(math.sqrt(max(1, self.n) / self.per_tile))))

    @cached_property
    def tile(self) -> int:
        """Side of the deepest tiles: a whole number of sites."""
        return -(-DIE // (SITE << self.max_z)) * SITE

    @property
    def side(self) -> int:
        return 1 << self.max_z

    @property
    def world(self) -> int:
        return self.tile << self.max_z

    @cached_property
    def means(self) -> tuple[float, float]:
        """Mean width and rect count over placements of cells and fillers."""
        r = self.placements().where("klass IN (0, 3)").agg(F.sum("w").alias("w"), F.sum("rc").alias("rc"), F.count(F.lit(1)).alias("n")).first()
        return (r["w"] / r["n"], r["rc"] / r["n"]) if r["n"] else (1.0, 1.0)

    @cached_property
    def instances(self) -> DataFrame:
        """i, block, x, y, o of the block's instances, five to a row."""
        pitch = int(self.world * 1.01)
        return self.table("nation").selectExpr("n_nationkey AS i", "0 AS block", f"CAST(n_nationkey % 5 AS BIGINT) * {pitch} AS x", f"CAST(n_nationkey div 5 AS BIGINT) * {pitch} AS y", "n_nationkey % 8 AS o")

    @cached_property
    def picks(self) -> DataFrame:
        """qid, cx, cy: points to identify."""
        return self.table("events").selectExpr("event_id AS qid", "(event_id * 7919) % 2500000 AS cx", "(event_id * 104729) % 2500000 AS cy")
