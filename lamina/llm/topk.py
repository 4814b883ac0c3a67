"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Queries are sparse rows. For a batch of candidates, each dimension (term) has
the postings (candidate, weight) of its non-zero components; a query's non-zero
components scatter their weighted postings into a dense score array. Each batch
keeps its best k of every query, and those are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import Scratch

#: Queries of one pass; with this many dimensions at most they are what a pass broadcasts.
QUERIES = 4096
#: Candidates that are scored together: bounds the dense score arrays.
CANDIDATES = 1024
#: Queries whose score arrays are held together.
GROUP = 256
#: Weights up to which sums of products of a dimension fit a long without a check.
SMALL = 1 << 24


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, weights): floor(scale * x) of each component, as double.

    Rows without a vec_id, with a null vector, or with a null or non-finite
    component are left out; an empty vector stays and scores 0.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))))
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("weights"))


def _dense(ids, lists, dims: int) -> np.ndarray:
    """Weights as a matrix; missing components are 0. Python integers where a long could overflow."""
    out = np.zeros((len(ids), dims), np.int64)
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    fits = col < dims
    out[row[fits], col[fits]] = flat[fits]
    return out


def _accumulate(queries: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Scores, term by term: each term's postings, weighted, into the rows of the queries that have it."""
    exact = max(np.abs(queries).max(initial=0), np.abs(cand).max(initial=0)) > SMALL
    scores = np.zeros((len(queries), len(cand)), object if exact else np.int64)
    for term in range(min(queries.shape[1], cand.shape[1])):
        posting, having = np.flatnonzero(cand[:, term]), np.flatnonzero(queries[:, term])
        if not len(posting) or not len(having):
            continue
        w, q = cand[posting, term], queries[having, term]
        if exact:
            w, q = w.astype(object), q.astype(object)
        if len(having) == len(queries) and len(posting) == len(cand):
            scores += q[:, None] * w
        else:
            scores[np.ix_(having, posting)] += q[:, None] * w
    if exact:
        top = (1 << 63) - 1
        scores = np.clip(scores, -top - 1, top).astype(np.int64)
    return scores


def _best(shared, k: int):
    """Best k candidates of each query in a partition."""

    def run(batches):
        qid, q = shared.value
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qid)

        def merge(ids, cand):
            for g in range(0, len(qid), GROUP):
                scores = _accumulate(q[g : g + GROUP], cand)
                for i, s in enumerate(scores, g):
                    other = ids != qid[i]
                    own, s = ids[other], s[other]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        own, s = own[s >= least], s[s >= least]
                    own, s = np.concatenate([held[i][0], own]), np.concatenate([held[i][1], s])
                    order = np.lexsort((own, -s))[:k]
                    held[i] = own[order], s[order]

        for batch in batches:
            for lo in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(lo, CANDIDATES)
                ids = part.column("vec_id").to_numpy()
                merge(ids, _dense(ids, pa.array(part.column("weights")), q.shape[1]))
        for lo in range(0, len(qid), 1024):
            some = held[lo : lo + 1024]
            n = [len(x[0]) for x in some]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[lo : lo + 1024], n)), pa.array(np.concatenate([x[0] for x in some])), pa.array(np.concatenate([x[1] for x in some]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's k candidates of the highest integer inner product: query_id, rank (from 1), vec_id, score.

    vectors and queries: (vec_id, weights array<long>), see quantised(). A
    candidate with the query's own vec_id isn't returned; ties go to the smaller
    vec_id. Vectors may differ in length: missing components count as 0. Scores
    beyond a long stop at its ends. Repeated rows of a query count once, repeated
    candidates each. Queries go through the executors in passes of QUERIES; more
    than one pass are gathered in the shared folder.
    """
    spark = vectors.sparkSession
    ids = queries.select("vec_id").distinct()
    passes = max(1, -(-ids.count() // QUERIES))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(passes))
    scratch, found = Scratch(spark, "top-k"), []
    kind = "query_id long, vec_id long, score long"
    for p in range(passes):
        # A pass of hashed ids may hold somewhat more than QUERIES; its size is bounded all the same.
        rows = queries.where(part == p).dropDuplicates(["vec_id"]).toArrow()
        qid = rows.column("vec_id").to_numpy()
        lists = rows.column("weights").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
        dims = int(np.diff(lists.offsets.to_numpy()).max(initial=0)) if len(lists) else 0
        order = np.argsort(qid, kind="stable")
        shared = spark.sparkContext.broadcast((qid[order], _dense(qid, lists, dims)[order]))
        best = vectors.select("vec_id", "weights").mapInArrow(_best(shared, k), kind)
        found.append(best if passes == 1 else scratch.write(best, f"pass{p}"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
