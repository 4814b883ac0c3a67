"""A seeded synthetic design: macros apart from each other, rows of cells between them, power straps.

Macros are the greedy choice among candidate places in the order of their
priorities. The first undecided ones are decided one by one, a bounded number
at a time, and then all that those taken conflict with go. Macros that are taken
don't overlap, so the die bounds their number and pairs of candidates are never listed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..sources.scratch import folder
from ..sources.tables import DIE, PITCH, SITE, Design

ROW_H = 1000
#: Macros of each master, places drawn for each, and the room that stays free around one.
COPIES, ATTEMPTS, PADDING = 12, 6, 20_000
#: Candidates that are decided one by one on the driver at a time.
AT_ONCE = 4096


def candidates(masters: DataFrame, seed: int, copies: int = COPIES, attempts: int = ATTEMPTS, die: int = DIE) -> DataFrame:
    """id, owner, prio, m, o, x0, y0, x1, y1: places drawn for each copy of each macro master, whole and on sites and rows."""
    own = masters.where("klass = 1").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    own = own.withColumn("owner", F.expr(f"m * {copies}L + c")).withColumn("id", F.expr(f"owner * {attempts}L + a"))
    o = draws.below(seed, 8, F.col("id"), F.lit(1)).cast("int")
    own = own.withColumn("o", o).withColumns({"bw": F.expr("if(o IN (2, 3, 6, 7), h, w)"), "bh": F.expr("if(o IN (2, 3, 6, 7), w, h)")}).where(f"bw <= {die} and bh <= {die}")
    x = draws.below(seed, F.expr(f"({die} - bw) div {SITE} + 1"), F.col("id"), F.lit(2)) * SITE
    y = draws.below(seed, F.expr(f"({die} - bh) div {ROW_H} + 1"), F.col("id"), F.lit(3)) * ROW_H
    own = own.withColumns({"x0": x, "y0": y, "prio": draws.draw(seed, F.col("id"), F.lit(4))})
    return own.selectExpr("id", "owner", "prio", "m", "o", "x0", "y0", "x0 + bw AS x1", "y0 + bh AS y1")


def first_come(nodes: DataFrame, edges: DataFrame, path: str, rounds: int = 200) -> DataFrame:
    """ids of nodes (id) that are taken one by one unless a taken one has an edge (a before b) with it."""
    spark = nodes.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    open_nodes, open_edges, taken = keep(nodes.select("id"), "nodes"), keep(edges, "edges"), None
    for k in range(rounds):
        now = keep(open_nodes.join(open_edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), f"taken{k}")
        taken = now if taken is None else taken.unionByName(now)
        gone = open_edges.join(now.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
        open_nodes = keep(open_nodes.join(now, "id", "left_anti").join(gone, "id", "left_anti"), f"nodes{k}")
        if open_nodes.isEmpty():
            return taken
        live = open_nodes.select(F.col("id"))
        open_edges = keep(open_edges.join(live.withColumnRenamed("id", "a"), "a").join(live.withColumnRenamed("id", "b"), "b"), f"edges{k}")
    raise RuntimeError(f"undecided places after {rounds} rounds")


def _greedy(rows: list, padding: int) -> list:
    """Of candidates in order those that conflict with none taken before."""
    taken, owners = [], set()
    box = np.zeros((len(rows), 4), np.int64)
    for r in rows:
        t = box[: len(taken)]
        if r["owner"] in owners or ((t[:, 0] < r["x1"] + padding) & (t[:, 1] < r["y1"] + padding) & (t[:, 2] > r["x0"] - padding) & (t[:, 3] > r["y0"] - padding)).any():
            continue
        box[len(taken)] = r["x0"], r["y0"], r["x1"], r["y1"]
        taken.append(r)
        owners.add(r["owner"])
    return taken


def macros(spark: SparkSession, masters: DataFrame, seed: int, copies: int = COPIES, attempts: int = ATTEMPTS, padding: int = PADDING, die: int = DIE, at_once: int = AT_ONCE) -> DataFrame:
    """id, m, o, x0, y0, x1, y1 of the macros of a design, one of each copy at most."""
    path = folder(spark, "macros")
    c = candidates(masters, seed, copies, attempts, die)
    c.write.parquet(f"{path}/places")
    undecided, chosen, k = spark.read.schema(c.schema).parquet(f"{path}/places"), [], 0
    while first := undecided.orderBy("prio", "id").limit(at_once).collect():
        taken = _greedy(first, padding)
        chosen += taken
        last = first[-1]
        near = F.broadcast(spark.createDataFrame(taken, c.schema).alias("t")) if taken else None
        left = undecided.where((F.col("prio") > last["prio"]) | (F.col("prio") == last["prio"]) & (F.col("id") > last["id"]))
        if near is not None:
            left = left.alias("c").join(near, F.expr(f"c.owner = t.owner or c.x0 < t.x1 + {padding} and t.x0 < c.x1 + {padding} and c.y0 < t.y1 + {padding} and t.y0 < c.y1 + {padding}"), "left_anti")
        left.write.parquet(f"{path}/undecided{k}")
        undecided, k = spark.read.schema(c.schema).parquet(f"{path}/undecided{k}"), k + 1
    return spark.createDataFrame(chosen, c.schema).select("id", "m", "o", "x0", "y0", "x1", "y1")


def cells(masters: DataFrame, boxes: DataFrame, seed: int, per_row: int, die: int = DIE) -> DataFrame:
    """m, o, x, y of cells and fillers: in each row per_row places are drawn by rank-weighted use and set one after another; what meets a macro's box goes.

    A draw finds its master in a table cut into as many slots as masters, so it
    meets a few of them and no task holds the library.
    """
    spark = masters.sparkSession
    lib = masters.where("klass IN (0, 3)")
    n = lib.count()
    if not n:
        return spark.createDataFrame([], "m long, o int, x long, y long")
    total = 1 << 31
    # Use falls with the rank of a master; sums of the parts of a thousand masters are few.
    ranked = lib.withColumn("part", F.expr("m div 1024")).withColumn("use", F.expr("cast(1e9 / (m + 3) as bigint)"))
    parts = ranked.groupBy("part").agg(F.sum("use").alias("s"))
    before = parts.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    every = parts.agg(F.sum("s")).first()[0]
    upto = F.col("base") + F.sum("use").over(Window.partitionBy("part").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    scaled = lambda c: F.expr(f"cast(cast({c} as decimal(20,0)) * {total} div {every} as bigint)")
    cdf = ranked.join(before, "part").withColumn("hi", upto).withColumns({"lo": scaled("hi - use"), "hi": scaled("hi")}).where("hi > lo")
    width = -(-total // n)
    table = cdf.select("m", "w", "h", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("slot"))
    rows = spark.range(die // ROW_H).withColumnRenamed("id", "r").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    drawn = rows.withColumn("u", draws.below(seed, total - 1, F.col("r"), F.col("k"), F.lit(5))).withColumn("slot", F.expr(f"u div {width}"))
    got = drawn.join(table, "slot").where("u >= lo and u < hi")
    gap = draws.below(seed, 4, F.col("r"), F.col("k"), F.lit(6)) * SITE
    end = F.sum(F.col("w") + gap).over(Window.partitionBy("r").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    laid = got.withColumn("x", end - F.col("w")).where(f"x + w <= {die}").select("m", F.expr("if(r % 2 = 0, 0, 5)").alias("o"), "x", F.expr(f"r * {ROW_H}").alias("y"), "w", "r")
    wall = boxes.select("x0", "x1", F.explode(F.expr(f"sequence(y0 div {ROW_H}, (y1 - 1) div {ROW_H})")).alias("r"))
    met = laid.join(wall, "r").where("x < x1 and x + w > x0").select("r", "x").distinct()
    return laid.join(met, ["r", "x"], "left_anti").select("m", "o", "x", "y")


def straps(masters: DataFrame, die: int = DIE) -> DataFrame:
    """m, o, x, y of the power grid: the first upright and the first lying strap master at every pitch, end to end."""
    spark = masters.sparkSession
    own = masters.where("klass = 2").groupBy(F.expr("h > w").alias("upright")).agg(F.min_by(F.struct("m", "w", "h"), "m").alias("s")).select("upright", "s.*")
    line = spark.range(die // PITCH).withColumnRenamed("id", "i")
    step = own.withColumn("long", F.greatest("w", "h")).withColumn("j", F.explode(F.expr(f"sequence(0L, {die} div long - 1)")))
    both = step.crossJoin(F.broadcast(line))  # lines of a die by pitch, times a handful of masters' steps
    return both.selectExpr("m", "0 AS o", f"if(upright, i * {PITCH}, j * long) AS x", f"if(upright, j * long, i * {PITCH}) AS y")


class SyntheticDesign(Design):
    """A design whose placements are drawn instead of read; the pyramid runs on it like on any other."""

    def __init__(self, spark: SparkSession, sf_dir: str, seed: int, per_row: int = 40, **more):
        super().__init__(spark, sf_dir, **more)
        path = folder(spark, "synthetic")
        boxes = macros(spark, self.masters, seed)
        boxes.write.parquet(f"{path}/macros")
        boxes = spark.read.schema(boxes.schema).parquet(f"{path}/macros")
        own = boxes.select("m", "o", F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(cells(self.masters, boxes, seed, per_row)).unionByName(straps(self.masters))
        own.write.parquet(f"{path}/placements")
        self.stored = spark.read.schema(own.schema).parquet(f"{path}/placements")

    def table(self, name: str) -> DataFrame:
        return self.stored if name == "lineitem" else super().table(name)

    def placements(self, numbers: bool = False) -> DataFrame:
        p = self.stored
        if numbers:
            from ..sources.tables import numbered

            p = numbered(p, ("y", "x", "m", "o"), "pno", max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return p.join(self.masters, "m").select(*(["pno"] if numbers else []), "m", "o", "x", "y", "klass", "w", "h", "rc")
