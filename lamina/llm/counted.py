"""Corpus-wide counts brought back to bounded runs of documents.

A chunk is a run of whole documents with its own list of keys: one row that
holds the keys as 64-bit integers, how often each counts, and any other bytes.
Counts are summed over all chunks by key and go back to each chunk in its own
order, so what is shuffled is a chunk's distinct keys and never its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Vectors in slices, with the number of the task that each comes from.
PARTS = "slice int, source int, part binary"


def occurrences(chunks: DataFrame) -> DataFrame:
    """(chunk, pos, key, n) from chunk, keys (64-bit integers) and counts (32-bit integers)."""

    def run(batches):
        for batch in batches:
            for c, keys, counts in zip(batch.column("chunk").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
                k, n = np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(counts.as_buffer(), np.int32)
                for lo in range(0, len(k), 1 << 16):
                    hi = min(len(k), lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, c)), pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(k[lo:hi]), pa.array(n[lo:hi])], names=["chunk", "pos", "key", "n"])

    return chunks.select("chunk", "keys", "counts").mapInArrow(run, "chunk long, pos int, key long, n int")


def totals(chunks: DataFrame) -> DataFrame:
    """(key, total) over all chunks; keys that count nowhere are left out."""
    return occurrences(chunks).where("n > 0").groupBy("key").agg(F.sum("n").alias("total"))


def with_totals(chunks: DataFrame, known: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """run(chunk row, arrays) for each chunk, arrays having a value of each of columns for each of its keys.

    known: (key, *columns), one row for each key; a key without a row, and a
    null, gives 0. columns are long. A chunk meets its own keys' rows alone,
    as many as it has keys, and run returns a table of schema.
    """
    back = occurrences(chunks).join(known, "key").select("chunk", "pos", *columns)

    def meet(own: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        pos = rows.column("pos").to_numpy()
        for row in own.to_pylist():
            arrays = []
            for c in columns:
                a = np.zeros(len(row["keys"]) // 8, np.int64)
                a[pos] = rows.column(c).fill_null(0).to_numpy()
                arrays.append(a)
            out.append(run(row, *arrays))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(meet, schema)


def summed(parts: DataFrame, scratch: Scratch, name: str, kind: str, size: int, slices: int) -> np.ndarray:
    """The sum of all vectors that are dealt as PARTS; kind is numpy's name of their type.

    A task adds the parts of some slices in the order of their sources, so sums
    of floats don't depend on which task was first; no task or driver holds more
    than one vector beside the parts of one batch.
    """

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, part in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                v = np.frombuffer(part.as_buffer(), kind)
                if s in held:
                    held[s] += v
                else:
                    held[s] = v.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["slice", "part"])

    out = np.zeros(size, kind)
    width = -(-size // slices)
    for r in scratch.write(parts.repartition(slices, "slice").sortWithinPartitions("slice", "source").mapInArrow(add, "slice int, part binary"), name).toLocalIterator():
        v = np.frombuffer(r["part"], kind)
        out[r["slice"] * width : r["slice"] * width + len(v)] += v
    scratch.drop(name)
    return out


def in_slices(vector: np.ndarray, slices: int, source: int) -> pa.RecordBatch:
    """A vector as PARTS for summed(); source tells it from others."""
    width = -(-len(vector) // slices)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(slices), pa.int32()), pa.array([source] * slices, pa.int32()), pa.array([vector[k * width : (k + 1) * width].tobytes() for k in range(slices)], pa.binary())], names=["slice", "source", "part"])
