"""Coverage holes: connected runs of missing tiles, labelled inside blocks of the grid and joined at the blocks' borders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Tiles across a block: a row of it is the bits of a long.
BLOCK = 64
#: Blocks that are labelled at once.
_AT_ONCE = 256
_EXISTS, _OUTSIDE = -1, -2
_PART = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("sx", pa.int64()), ("sy", pa.int64()), ("touches", pa.bool_())])
_SIDES = {"west": np.s_[:, :, 0], "east": np.s_[:, :, -1], "north": np.s_[:, 0, :], "south": np.s_[:, -1, :]}
_LABELLED = "bx long, by long, parts array<struct<node: long, n: long, sx: long, sy: long, touches: boolean>>, " + ", ".join(f"{s} array<long>" for s in _SIDES)


def coverage_holes(tiles: DataFrame, side: int, wide: int | None = None, high: int | None = None) -> DataFrame:
    """4-connected components of tiles that are missing but touch an existing one somewhere: hole, tiles, cx, cy.

    tiles (tx, ty) exist, in a grid of side x side of which wide x high lie in
    the die; others there aren't missing. A hole is named by its least
    ty * side + tx. Rows of tiles become bits; each block of 64 x 64 is labelled
    by itself, and what reaches its border meets the next block's. So rounds
    depend on how blocks hang together, not on how long a hole is.
    """
    blocks = _labelled(tiles, side, side if wide is None else wide, side if high is None else high)
    met = [
        blocks.select((F.col("bx") + 1).alias("bx"), "by", F.col("east").alias("a")).join(blocks.select("bx", "by", F.col("west").alias("b")), ["bx", "by"]),
        blocks.select("bx", (F.col("by") + 1).alias("by"), F.col("south").alias("a")).join(blocks.select("bx", "by", F.col("north").alias("b")), ["bx", "by"]),
    ]
    pairs = met[0].unionByName(met[1]).select(F.explode(F.array_distinct(F.arrays_zip("a", "b"))).alias("p")).select("p.a", "p.b")
    root = connected(pairs.where("a >= 0 and b >= 0"))
    touched = pairs.where(f"a >= 0 and b = {_EXISTS}").select("a").union(pairs.where(f"b >= 0 and a = {_EXISTS}").select("b")).distinct().select(F.col("a").alias("node"), F.lit(True).alias("beside"))
    parts = blocks.select(F.explode("parts").alias("p")).select("p.*").join(root, "node", "left").join(touched, "node", "left")
    whole = parts.groupBy(F.coalesce("root", "node").alias("hole")).agg(F.sum("n").alias("tiles"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.bool_or(F.col("touches") | F.col("beside").isNotNull()).alias("touches"))
    return whole.where("touches").selectExpr("hole", "tiles", "sx div tiles AS cx", "sy div tiles AS cy")


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root: the least node that edges (a, b) connect each node with; only nodes that have an edge, roots left out.

    Tasks first replace their edges by stars that connect the same nodes. Every round points each node's larger neighbours, then its smaller ones, at
    the least node it knows, until the edges are those of the round before. They
    are written in between and compared by a digest of 64 bits.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select("a", "b").distinct().mapInArrow(_stars, "a long, b long")
    digest, path = None, None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = up.groupBy("a").agg(F.min("b").alias("low"))
        down = up.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(least.select("a", "low")).distinct()
        was, before, path = digest, path, scratch.folder(spark, "connected")
        down.write.parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        if before:
            scratch.drop(spark, before)
        digest = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if digest == was or not digest[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components aren't settled after {rounds} rounds")


def _stars(batches):
    """Edges of a task as those from each node to the least one that they connect it with."""
    held = [b for b in batches if b.num_rows]
    if held:
        ends = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        root = _joined(len(nodes), *np.split(at, 2))
        leaf = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_pydict({"a": nodes[leaf], "b": nodes[root[leaf]]})


def _labelled(tiles: DataFrame, side: int, wide: int, high: int) -> DataFrame:
    """Blocks as a table on disk: their parts (components inside them) and the part at each place of their four sides."""
    spark = tiles.sparkSession
    across = -(-side // BLOCK)
    grid = spark.range(across * across).selectExpr(f"id % {across} AS bx", f"id div {across} AS by")
    bits = tiles.groupBy(F.expr(f"tx div {BLOCK}").alias("bx"), F.expr(f"ty div {BLOCK}").alias("by"), F.expr(f"cast(ty % {BLOCK} as int)").alias("row")).agg(F.expr(f"bit_or(shiftleft(1L, cast(tx % {BLOCK} as int)))").alias("bits"))
    rows = bits.groupBy("bx", "by").agg(F.map_from_entries(F.collect_list(F.struct("row", "bits"))).alias("at"))
    masks = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0).cast("long")))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                yield _label(batch.slice(at, _AT_ONCE), side, wide, high)

    path = scratch.folder(spark, "blocks")
    grid.join(rows, ["bx", "by"], "left").select("bx", "by", masks.alias("bits")).mapInArrow(run, _LABELLED).write.parquet(path)
    return spark.read.schema(_LABELLED).parquet(path)


def _label(batch: pa.RecordBatch, side: int, wide: int, high: int) -> pa.RecordBatch:
    bx, by = (batch.column(c).to_numpy() for c in ("bx", "by"))
    bits = np.ascontiguousarray(batch.column("bits").flatten().to_numpy(), "<i8").view(np.uint8)
    there = np.unpackbits(bits, bitorder="little").reshape(-1, BLOCK, BLOCK).astype(bool)
    tx = np.broadcast_to(bx[:, None, None] * BLOCK + np.arange(BLOCK)[None, None, :], there.shape)
    ty = np.broadcast_to(by[:, None, None] * BLOCK + np.arange(BLOCK)[None, :, None], there.shape)
    missing = ~there & (tx < min(wide, side)) & (ty < min(high, side))
    # Runs along rows, in reading order, are joined where they lie above each other.
    starts = missing.copy()
    starts[:, :, 1:] &= ~missing[:, :, :-1]
    run = (np.cumsum(starts.ravel()) - 1).reshape(starts.shape)
    n = int(starts.sum())
    over = missing[:, 1:] & missing[:, :-1]
    root = _joined(n, run[:, :-1][over], run[:, 1:][over])
    node = (ty * side + tx)[starts]
    own = root[run[missing]]
    code = np.where(there, _EXISTS, _OUTSIDE)
    code[missing] = node[own]
    beside = np.zeros_like(there)
    beside[:, :, 1:] |= there[:, :, :-1]
    beside[:, :, :-1] |= there[:, :, 1:]
    beside[:, 1:] |= there[:, :-1]
    beside[:, :-1] |= there[:, 1:]
    add = lambda v: np.bincount(own, v, n).astype(np.int64)
    size, sx, sy, touches = add(None), add(tx[missing]), add(ty[missing]), add(beside[missing]) > 0
    first = np.flatnonzero(root == np.arange(n))
    ends = np.searchsorted(np.flatnonzero(starts.ravel())[first], np.arange(len(bx) + 1) * BLOCK * BLOCK)
    parts = pa.StructArray.from_arrays([pa.array(v[first]) for v in (node, size, sx, sy, touches)], fields=list(_PART))
    fixed = pa.array(np.arange(len(bx) + 1, dtype=np.int32) * BLOCK)
    sides = {s: pa.ListArray.from_arrays(fixed, pa.array(code[at].ravel())) for s, at in _SIDES.items()}
    return pa.RecordBatch.from_pydict({"bx": batch.column("bx"), "by": batch.column("by"), "parts": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), parts), **sides})


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that the pairs (a, b) connect each with."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
