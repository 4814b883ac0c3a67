"""Groups of any size as blocks of bounded size, and the pairs of rows within them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are looked at together.
PAIRS = 1 << 20


def deal(df: DataFrame, keys: list[str], tie: str, rows: str, block: int) -> DataFrame:
    """Copies each row of a group into the blocks (i, j) of its chunk and every other one, and adds chunk, i and j.

    A group of `rows` rows has rows/block chunks, so any two of its rows meet in
    one block, and no block has more than about two chunks.
    """
    c = F.ceil(F.col(rows) / block).cast("int")
    cut = df.withColumn("_c", c).withColumn("chunk", F.pmod(F.xxhash64(tie, F.lit(7)), F.col("_c")).cast("int"))
    cut = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).withColumn("i", F.least("chunk", "_o")).withColumn("j", F.greatest("chunk", "_o")).drop("_c", "_o")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut.repartition(parts, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def runs(batches, keys):
    """Tables of whole runs of equal keys, from batches sorted by them; a run is never split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = bool(held) and all(held[-1].column(c)[len(held[-1]) - 1] == batch.column(c)[0] for c in keys)
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        if same:
            first = int(cuts[0]) if len(cuts) else batch.num_rows
            held.append(batch.slice(0, first))
            batch, cuts = batch.slice(first), cuts[1:] - first
            if not batch.num_rows:
                continue
        if held:
            yield pa.Table.from_batches(held).combine_chunks()
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs(table: pa.Table, keys: list[str]):
    """(i, j) of the pairs of rows that share a block, each block's rows together, at most about PAIRS at a time.

    In a block of one chunk these are all pairs of its rows, in one of two
    chunks the pairs across them.
    """
    k = np.stack([table.column(c).to_numpy() for c in (*keys, "i", "j")])
    first = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1])
    size = np.diff(np.concatenate([first, [table.num_rows]]))
    across = k[-2, first] != k[-1, first]
    chunk = table.column("chunk").to_numpy()
    for b in np.flatnonzero(across).tolist():
        own = np.arange(first[b], first[b] + size[b])
        low = chunk[own] == k[-2, first[b]]
        left, right = own[low], own[~low]
        step = max(1, PAIRS // max(1, len(right)))
        for lo in range(0, len(left), step):
            part = left[lo : lo + step]
            yield np.repeat(part, len(right)), np.tile(right, len(part))
    one = np.flatnonzero(~across & (size > 1))
    first, size = first[one], size[one]
    todo, lo = np.cumsum(size * (size - 1) // 2), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(todo, (todo[lo - 1] if lo else 0) + PAIRS, "right")))
        n = size[lo:hi]
        stop = np.repeat(first[lo:hi] + n, n)
        row = np.arange(int(n.sum())) + np.repeat(first[lo:hi] - (np.cumsum(n) - n), n)
        more = stop - row - 1
        i = np.repeat(row, more)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more) + i + 1
        lo = hi
