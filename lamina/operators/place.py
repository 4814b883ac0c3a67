"""Row placement: free spans between obstacles, and filling them in file order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import DIE, Design


def rows(spark: SparkSession, n: int, step: int = 1) -> DataFrame:
    """r of placement rows of height 1000."""
    return spark.range(0, n, step).withColumnRenamed("id", "r")


def obstacles(d: Design) -> DataFrame:
    """Oriented boxes of fixed macros."""
    w, h = "CASE WHEN o IN (2, 3, 6, 7) THEN h ELSE w END", "CASE WHEN o IN (2, 3, 6, 7) THEN w ELSE h END"
    return d.placements().where("klass = 1").selectExpr("x AS x0", f"x + {w} AS x1", "y AS y0", f"y + {h} AS y1")


def crossing(rows: DataFrame, boxes: DataFrame, row_h: int = 1000, width: int = DIE) -> DataFrame:
    """r, x0, x1 of the boxes across each row: boxes list their rows, so the join is on the row."""
    b = boxes.where(f"x0 < {width}").withColumn("r", F.explode(F.expr(f"sequence(greatest(y0 div {row_h}, 0L), greatest((y1 - 1) div {row_h}, 0L))")))
    return rows.join(b, "r").selectExpr("r", "greatest(x0, 0L) AS x0", f"least(x1, {width}L) AS x1")


def free_spans(rows: DataFrame, boxes: DataFrame, row_h: int = 1000, width: int = DIE) -> DataFrame:
    """r, s, e: what boxes leave free of each row."""
    blocked = crossing(rows, boxes, row_h, width)
    # An end marker on every row, so that the last gap is a gap like others.
    marked = blocked.unionByName(rows.selectExpr("r", f"{width}L AS x0", f"{width}L AS x1"))
    reach = F.max("x1").over(Window.partitionBy("r").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("s", F.coalesce(reach, F.lit(0).cast("long"))).where("x0 > s").select("r", "s", F.col("x0").alias("e"))


def design_rows(rows: DataFrame) -> DataFrame:
    """r, x, x1, y, step, orient of a design's row statements: their order, extent, height and site step."""
    order = Window.orderBy("y", "x", "name")  # rows of a die, some per row height
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("r"), "x", F.expr("x + nx * step").alias("x1"), "y", "step", "orient")


def row_spans(rows: DataFrame, boxes: DataFrame, row_h: int) -> DataFrame:
    """rows (r, x, x1, y, ...) with s, e: what boxes leave free of each. Rows and boxes meet in bands of a row's height."""
    band = lambda lo, hi: F.explode(F.expr(f"sequence(floor({lo} / {row_h}), floor(({hi} - 1) / {row_h}))"))
    a = rows.select("r", "x", "x1", "y", band("y", f"(y + {row_h})").alias("band"))
    b = boxes.where("x1 > x0 and y1 > y0").select("x0", F.col("x1").alias("bx1"), "y0", "y1", band("y0", "y1").alias("band"))
    hit = a.join(b, "band").where(f"x0 < x1 and bx1 > x and y0 < y + {row_h} and y1 > y").select("r", "x", F.expr("greatest(x0, x) AS x0"), F.expr("least(bx1, x1) AS x1"))
    marked = hit.unionByName(rows.selectExpr("r", "x", "x1 AS x0", "x1"))
    reach = F.max("x1").over(Window.partitionBy("r").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    gaps = marked.withColumn("s", F.coalesce(reach, F.col("x"))).where("x0 > s").select("r", "s", F.col("x0").alias("e"))
    return rows.join(gaps, "r")


def _laid(spans, cells, at: int, charged: int, places: bool):
    """Takes cells span by span; returns the next cell's offset, the width charged so far, and (pno, x, span) of each place.

    spans: arrays s, e, x, step, limit; cells: arrays c0, c1, pno in order.
    """
    c0, c1 = cells["c0"], cells["c1"]
    k, n, out = int(np.searchsorted(c0, at)), len(c0), []
    for i, (s, e, origin, step, limit) in enumerate(zip(*(spans[c].tolist() for c in ("s", "e", "x", "step", "limit")), strict=True)):
        if k >= n:
            break
        budget = min(e - s, limit - charged)
        first = int(c0[k])
        take = int(np.searchsorted(c1, first + budget, "right")) - k
        if take <= 0:
            continue
        total = int(c1[k + take - 1]) - first
        charged += total
        if not places and (s - origin) % step == 0:
            k += take  # snapping down from a site never runs over the end
            continue
        gap = (e - s - total) / take
        x = float(s)
        for j in range(k, k + take):
            at_x = math.floor((x - origin) / step) * step + origin
            if at_x < s:
                at_x = -(-(s - origin) // step) * step + origin
            w = int(c1[j] - c0[j])
            if at_x + w > e:
                break
            out.append((j, at_x, i))
            k += 1
            x = at_x + w + gap
    return (int(c0[k]) if k < n else int(c1[-1]) if n else at), charged, out


def fill(spans: DataFrame, cells: DataFrame, blocks: int | None = None) -> DataFrame:
    """Places cells (pno, w) in the order of pno into spans (r, s, e, x, y, step, o): pno, x, y, o.

    A span's budget is its share of all cells' width and what the ones before
    could not spend, and its own width at most; it takes whole cells while they
    fit, spaces them evenly and snaps them down to its row's sites. A cell that
    doesn't end inside its span ends the span; it is charged to it and comes
    first in the next. Cells that are left over have null places; so have all
    cells where they are wider than all spans together.

    All that a span needs to know of the ones before is where the next cell
    begins in the sum of widths and how much width was charged. Blocks of spans
    are replayed at once from a guess, the cell at which the share of width
    before them ends; blocks whose guess wasn't what the one before ended with
    are replayed from that, until all agree. A round settles one block at least,
    and mostly all, as a span with room to spare forgets the carry before it.
    Arithmetic on widths is exact.
    """
    spark = cells.sparkSession
    by = cells.where("w > 0").withColumn("part", F.expr("pno div 65536"))
    sums = by.groupBy("part").agg(F.sum("w").alias("own"))
    starts = sums.select("part", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("w").over(Window.partitionBy("part").orderBy("pno").rowsBetween(Window.unboundedPreceding, 0))
    line = by.join(starts, "part").withColumn("c1", F.col("before") + upto).select("pno", F.expr("c1 - w AS c0"), "c1")
    total, widest = cells.where("w > 0").agg(F.sum("w"), F.max("w")).first()
    total, widest = total or 0, widest or 0
    per_row = spans.groupBy("r").agg(F.sum(F.expr("e - s")).alias("own"))
    row_starts = per_row.select("r", F.coalesce(F.sum("own").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    free = per_row.agg(F.sum("own")).first()[0] or 0
    if total > free:
        return cells.selectExpr("pno", "cast(null as long) AS x", "cast(null as long) AS y", "cast(null as int) AS o")
    blocks = blocks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), free // (1 << 36))
    inside = F.sum(F.expr("e - s")).over(Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    wide = spans.join(row_starts, "r").withColumn("reach", F.col("before") + inside)
    wide = wide.withColumn("limit", F.expr(f"cast(cast(reach as decimal(18,0)) * cast({total} as decimal(18,0)) div {max(1, free)} as long)"))
    wide = wide.withColumn("block", F.expr(f"cast(cast(reach - (e - s) as decimal(18,0)) * {blocks} div {max(1, free)} as int)"))
    ends = {r["block"]: r["hi"] for r in wide.groupBy("block").agg(F.max("limit").alias("hi")).collect()}
    order = sorted(ends)
    grain = max(1, total // blocks)
    fields = ["r", "s", "e", "x", "y", "step", "o", "limit"]

    def run(entries: dict[int, tuple[int, int] | None], places: bool) -> DataFrame:
        """Replays blocks from where they begin; None: from the cell where the share before them ends."""
        rows = []
        for b, begin in entries.items():
            low = ends[order[order.index(b) - 1]] if b != order[0] else 0
            at, charged = begin if begin is not None else (-1, low)
            rows.append((b, at, charged, at if begin is not None else low - widest, ends[b]))
        where = spark.createDataFrame(rows, "block int, at long, charged long, lo long, hi long")
        keys = where.select("block", "lo", "hi", F.explode(F.expr(f"sequence(floor(lo / {grain}), floor(hi / {grain}))")).alias("key"))
        own = line.withColumn("key", F.expr(f"floor(c0 / {grain})")).join(F.broadcast(keys), "key").where("c0 >= lo and c1 <= hi").select("block", "pno", "c0", "c1")
        part = wide.join(F.broadcast(where), "block").select("block", *fields, "at", "charged")

        def lay(key, left, right):
            left, right = left.sort_values(["r", "s"]), right.sort_values("c0")
            at, charged = int(left["at"].iloc[0]), int(left["charged"].iloc[0])
            c = {n: right[n].to_numpy(np.int64) for n in ("c0", "c1", "pno")}
            if at < 0:
                k = int(np.searchsorted(c["c1"], charged, "right"))
                at = charged = int(c["c1"][k - 1]) if k else 0
            begin = (at, charged)
            at, charged, out = _laid({n: left[n].to_numpy(np.int64) for n in ("s", "e", "x", "step", "limit")}, c, at, charged, places)
            if not places:
                return pd.DataFrame([(int(key[0]), *begin, at, charged)], columns=["block", "at", "charged", "at_end", "charged_end"])
            j, x, i = (np.array(v, np.int64) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            return pd.DataFrame({"pno": c["pno"][j], "x": x, "y": left["y"].to_numpy(np.int64)[i], "o": left["o"].to_numpy(np.int32)[i]})

        schema = "pno long, x long, y long, o int" if places else "block int, at long, charged long, at_end long, charged_end long"
        return part.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(lay, schema)

    begins: dict[int, tuple[int, int]] = {}
    closes: dict[int, tuple[int, int]] = {}
    todo: dict[int, tuple[int, int] | None] = {b: (0, 0) if b == order[0] else None for b in order}
    while todo:
        for r in run(todo, False).collect():
            begins[r["block"]], closes[r["block"]] = (r["at"], r["charged"]), (r["at_end"], r["charged_end"])
        todo = {b: closes[a] for a, b in zip(order, order[1:], strict=False) if begins[b] != closes[a]}
    none = line.sparkSession.createDataFrame([], "pno long, x long, y long, o int")
    end = closes[order[-1]][0] if order else 0
    loose = line.where(F.col("c0") >= end).select("pno").unionByName(cells.where("not w > 0 or w is null").select("pno"))
    left = loose.selectExpr("pno", "cast(null as long) AS x", "cast(null as long) AS y", "cast(null as int) AS o")
    return (run(begins, True) if order else none).unionByName(left)


def density(u, v, seed: int, lo: float = 0.4, hi: float = 0.95):
    """Two octaves of smooth value noise over the unit square, mapped to lo..hi."""
    total = np.zeros_like(u)
    for octave, (cells, weight) in enumerate(((4, 0.7), (9, 0.3))):
        grid = np.random.default_rng([seed, octave]).random((cells + 2, cells + 2))
        x, y = u * cells, v * cells
        i, j = np.floor(x).astype(int), np.floor(y).astype(int)
        a, b = x - i, y - j
        a, b = a * a * (3 - 2 * a), b * b * (3 - 2 * b)
        top = grid[j, i] * (1 - a) + grid[j, i + 1] * a
        low = grid[j + 1, i] * (1 - a) + grid[j + 1, i + 1] * a
        total += weight * (top * (1 - b) + low * b)
    return lo + (hi - lo) * total


def synthetic_rows(spark: SparkSession, d: Design, n: int, seed: int) -> DataFrame:
    """r, x, m, o of n synthetic rows: draw a cell by weight, keep it where density allows, advance until the row is full.

    Rows are drawn independently; each task holds the library's widths and weights.
    """
    lib = d.masters.where("klass IN (0, 3)").selectExpr("m", "w", "1.0D / pow(m + 2.7D, 1.05D) AS wt").toPandas().sort_values("m")
    cdf, width, name = np.cumsum(lib["wt"].to_numpy()), lib["w"].to_numpy(), lib["m"].to_numpy()
    shared = spark.sparkContext.broadcast((cdf, width, name))

    def one(frames):
        cdf, width, name = shared.value
        for f in frames:
            for r in f["r"]:
                rng = np.random.default_rng([seed, int(r)])
                drawn, end = [], 0
                while len(cdf) and end < DIE:
                    k = np.searchsorted(cdf, rng.random(1024) * cdf[-1], "right").clip(0, len(cdf) - 1)
                    drawn.append(k)
                    end += int(width[k].sum())
                k = np.concatenate([np.zeros(0, int), *drawn])
                x = np.cumsum(width[k]) - width[k]
                k, x = k[x + width[k] <= DIE], x[x + width[k] <= DIE]
                keep = rng.random(len(x)) < density(np.minimum(x / DIE, 0.999), np.full(len(x), min(r / n, 0.999)), seed)
                yield pd.DataFrame({"r": np.full(keep.sum(), r), "x": x[keep].astype(np.int64), "m": name[k][keep], "o": np.full(keep.sum(), 0 if r % 2 == 0 else 5, np.int32)})

    return rows(spark, n).mapInPandas(one, "r long, x long, m long, o int")
