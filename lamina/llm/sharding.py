"""Sharding by a k-d tree over document metadata.

Every node is split at the weighted median (by bytes) of its widest dimension
until the leaves reach the target size. All nodes of a level are split together,
by histograms that the executors sum and search and that are narrowed until one
bin's weight no longer matters; one row for each node reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, salted_rank

#: Bins of a node's histogram in each pass.
BINS = 1024
#: Share of a node's bytes that may lie between a median and its cut.
TOLERANCE = 1 / 4000
_HALF = 1 << 31

#: Metadata dimensions. Equal texts agree in the first two, so they stay together unless a cut falls inside their group.
DIMENSIONS = ("text_crc32", "size", "source", "lang", "doc_id")


def _metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    have = set(docs.columns)
    name = {c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) if c in have else F.lit(0).cast("long") for c in ("source", "lang")}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), name["source"].alias("source"), name["lang"].alias("lang"))


def kd_shards(docs: DataFrame, target_bytes: int | None = None, depth: int | None = None) -> DataFrame:
    """Shards of nearly equal bytes: doc_id, size, text_crc32, shard, slot, one row per input row.

    size is the UTF-8 bytes of the text (null: none) plus 1. The tree has depth
    levels, or as many as bring leaves to target_bytes or less, on average. Ties
    in a dimension are ordered by a hash of doc_id, so a group of equal values
    may be cut anywhere; only rows of one doc_id always stay together. A null
    doc_id counts as the least. slot numbers a shard's rows from 0 without gaps.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(_metadata(docs), "rows")
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *(x for c in DIMENSIONS for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")))).first()
    if not first["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if depth is None:
        depth = max(0, (-(-first["bytes"] // max(1, target_bytes)) - 1).bit_length())

    # Each dimension as 31 bits of its place in its range, then 31 bits that order ties.
    tie = F.xxhash64("doc_id").bitwiseAND(F.lit(_HALF - 1))
    keys = {}
    for c in DIMENSIONS:
        lo, hi = first[f"{c}_lo"] or 0, first[f"{c}_hi"] or 0
        place = F.floor((F.coalesce(F.col(c), F.lit(lo)).cast("double") - F.lit(float(lo))) / F.lit(float(max(1, hi - lo))) * F.lit(float(_HALF - 1))).cast("long")
        keys[c] = place * F.lit(_HALF) + tie
    at = rows.select("doc_id", "size", "text_crc32", *(k.alias(f"k_{c}") for c, k in keys.items()), F.lit(0).alias("node"))

    for level in range(depth):
        nodes = 1 << level
        spread = at.groupBy("node").agg(F.sum("size").alias("bytes"), *(x for c in DIMENSIONS for x in (F.min(f"k_{c}").alias(f"{c}_lo"), F.max(f"k_{c}").alias(f"{c}_hi")))).collect()
        dim, lo, hi, below, total = ["doc_id"] * nodes, [0] * nodes, [0] * nodes, [0] * nodes, [0] * nodes
        for r in spread:
            i = r["node"]
            dim[i] = max(DIMENSIONS, key=lambda c: (r[f"{c}_hi"] // _HALF - r[f"{c}_lo"] // _HALF, -DIMENSIONS.index(c)))
            lo[i], hi[i], total[i] = r[f"{dim[i]}_lo"], r[f"{dim[i]}_hi"] + 1, r["bytes"]
        known = list(at.columns)
        cut: list = [None if total[i] else 0 for i in range(nodes)]
        while any(c is None for c in cut):
            width = [max(1, -(-(hi[i] - lo[i]) // BINS)) for i in range(nodes)]
            params = [(i, DIMENSIONS.index(dim[i]) + 1, lo[i], hi[i], width[i], below[i], total[i]) for i in range(nodes) if cut[i] is None]
            params = F.broadcast(at.sparkSession.createDataFrame(params, "node int, dim int, lo long, hi long, width long, below long, total long"))
            here = at.join(params, "node").withColumn("key", F.element_at(F.array(*(F.col(f"k_{c}") for c in DIMENSIONS)), F.col("dim"))).where("key >= lo and key < hi")
            # Each node's histogram is summed and searched on the executors; the bin with its median comes back.
            bins = here.groupBy("node", F.expr("(key - lo) div width").cast("int").alias("bin")).agg(F.sum("size").alias("bytes"), F.first("below").alias("below"), F.first("total").alias("total"))
            before = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
            sums = bins.withColumn("before", F.col("below") + F.coalesce(F.sum("bytes").over(before), F.lit(0))).where("2 * (before + bytes) >= total")
            for r in sums.groupBy("node").agg(F.min(F.struct("bin", "before", "bytes")).alias("m")).select("node", "m.*").collect():
                i, start, after = r["node"], lo[r["node"]] + r["bin"] * width[r["node"]], r["before"] + r["bytes"]
                if width[i] == 1 or r["bytes"] <= TOLERANCE * total[i]:
                    # Keys under the cut go left: before or after this bin, whichever is nearer to half.
                    cut[i] = start if total[i] - 2 * r["before"] <= 2 * after - total[i] else start + width[i]
                else:
                    below[i], lo[i], hi[i] = r["before"], start, start + width[i]
        cuts = at.sparkSession.createDataFrame([(i, DIMENSIONS.index(dim[i]) + 1, cut[i]) for i in range(nodes)], "node int, dim int, cut long")
        right = F.element_at(F.array(*(F.col(f"k_{c}") for c in DIMENSIONS)), F.col("dim")) >= F.col("cut")
        at = at.join(F.broadcast(cuts), "node").withColumn("node", F.col("node") * 2 + right.cast("int")).select(known)

    placed = scratch.write(at.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard")), "placed")
    scratch.drop("rows")
    return salted_rank(placed, ["shard"], "doc_id", "slot", first["n"]).select("doc_id", "size", "text_crc32", "shard", "slot")
