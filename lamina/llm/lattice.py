"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random and decoded to the nearest points of the
lattice E8, block by block, in several tables. Vectors meet in a lattice cell if
it is the home of one and the home or the probed neighbouring cell of the other;
each pair that meets is verified by its cosine, in double precision, in the
first table and cell where it does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .blocks import deal, pairs, runs
from .shared import Scratch, connected_components

COSINE = 0.98
TABLES = 8
#: E8 blocks of a cell: 8 dimensions of the projection each.
BLOCKS = 3
#: Size of the lattice against a typical component of a unit vector, 1 / sqrt(dimensions), so that cells hold
#: the same share of unrelated vectors whatever the length (about one pair in a thousand meets).
SCALE = 2.8
#: Rows of a cell that are compared in one block.
BLOCK = 1024


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers with an even sum."""
    r = np.rint(x)
    off = x - r
    k = np.abs(off).argmax(-1)[..., None]
    odd = (r.sum(-1) % 2 != 0)[..., None]
    flip = np.where(np.take_along_axis(off, k, -1) >= 0, 1.0, -1.0)
    np.put_along_axis(r, k, np.take_along_axis(r, k, -1) + np.where(odd, flip, 0.0), -1)
    return r


def e8(x: np.ndarray):
    """Nearest points of E8, the nearest of its other coset, and how much farther that is."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    da, db = ((x - a) ** 2).sum(-1), ((x - b) ** 2).sum(-1)
    near = (da <= db)[..., None]
    return np.where(near, a, b), np.where(near, b, a), np.abs(da - db)


_BASES: dict = {}


def _basis(dims: int, table: int):
    if (dims, table) not in _BASES:
        rng = np.random.default_rng([11, dims, table])
        width = 8 * BLOCKS
        g = rng.normal(size=(max(dims, width), width))
        q = np.linalg.qr(g)[0][:dims]
        _BASES[dims, table] = q * (np.sqrt(max(dims, width)) / SCALE), rng.random(width)
    return _BASES[dims, table]


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home and probed cell of each unit vector in each table, as hashes."""
    n, dims = unit.shape
    home, probe = np.zeros((n, TABLES), np.int64), np.zeros((n, TABLES), np.int64)
    for t in range(TABLES):
        q, shift = _basis(dims, t)
        near, other, gap = e8((unit @ q + shift).reshape(n, BLOCKS, 8))
        k = gap.argmin(1)
        side = near.copy()
        side[np.arange(n), k] = other[np.arange(n), k]
        for out, point in ((home, near), (probe, side)):
            h = np.full(n, t + 1, np.uint64)
            for c in (2 * point.reshape(n, -1)).astype(np.int64).view(np.uint64).T:
                h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
            out[:, t] = h.view(np.int64)
    return home, probe


def _units(lists: pa.Array):
    """Unit vectors by length of the vector: (rows, matrix)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat, start = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
    for dims in np.unique(size).tolist():
        rows = np.flatnonzero(size == dims)
        x = flat[start[rows][:, None] + np.arange(dims)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


@K.lean
def _keys(batches):
    """(cell, lh, dims, rep, home) of each representative: its home and probed cells."""
    for batch in batches:
        rep, lh = batch.column("rep").to_numpy(), batch.column("lh").to_numpy()
        if not batch.num_rows:
            continue
        for rows, unit in _units(batch.column("x")):
            home, probe = cells(unit)
            n = len(rows)
            every = np.concatenate([home, probe], 1).ravel()
            own = np.repeat(rows, 2 * TABLES)
            at_home = np.tile(np.repeat([True, False], TABLES), n)
            # Vectors of different lengths have no cosine.
            key = K.mix(every.view(np.uint64) ^ np.uint64(unit.shape[1])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lh[own]), pa.array(rep[own]), pa.array(at_home)], names=["cell", "lh", "rep", "home"])


def _links(cosine: float):
    """From blocks of rows (cell, lh, i, j, chunk, rep, copies, home, x): links of each representative in the block,
    weighted by copies, and edges that span the linked ones."""

    def first_meeting(hu, pu, hv, pv, cell):
        """Whether each pair (rows of homes and probes) meets in this cell first."""
        same, left, right = hu == hv, hu == pv, hv == pu
        meet = same | left | right
        table = meet.argmax(1)
        at = np.arange(len(table))
        # In one table the cell is the common home, else u's home that v probes, else v's.
        own = np.where(same[at, table] | left[at, table], hu[at, table], hv[at, table])
        return meet.any(1) & (own == cell)

    def run(batches):
        for t in runs(batches, ["cell", "lh", "i", "j"]):
            rep, copies, cell, home = (t.column(c).to_numpy() for c in ("rep", "copies", "cell", "home"))
            h, p = np.zeros((t.num_rows, TABLES), np.int64), np.zeros((t.num_rows, TABLES), np.int64)
            groups = list(_units(t.column("x")))
            width = max(u.shape[1] for _, u in groups)
            unit = np.zeros((t.num_rows, width))
            for rows, u in groups:
                unit[rows, : u.shape[1]] = u
                a, b = cells(u)
                d = np.uint64(u.shape[1])
                h[rows], p[rows] = (K.mix(x.view(np.uint64) ^ d).view(np.int64) for x in (a, b))
            found = []
            for i, j in pairs(t, ["cell", "lh"]):
                for lo in range(0, len(i), 1 << 15):
                    a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                    ok = (rep[a] != rep[b]) & (home[a] | home[b])
                    a, b = a[ok], b[ok]
                    ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                    a, b = a[ok], b[ok]
                    # The smaller id is u, so that every block decides alike.
                    u, v = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
                    ok = first_meeting(h[u], p[u], h[v], p[v], cell[u])
                    if ok.any():
                        found.append(np.stack([u[ok], v[ok]]))
            if not found:
                continue
            u, v = np.concatenate(found, 1)
            links = np.bincount(u, weights=copies[v], minlength=t.num_rows) + np.bincount(v, weights=copies[u], minlength=t.num_rows)
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[has]), pa.array(links[has].astype(np.int64)), pa.nulls(len(has), pa.int64())], names=["rep", "links", "other"])
            # A spanning forest stands for the block's links.
            root = np.arange(t.num_rows)

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            edges = []
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[ra] = rb
                    edges.append((a, b))
            e = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(rep[e[0]]), pa.nulls(len(edges), pa.int64()), pa.array(rep[e[1]])], names=["rep", "links", "other"])

    return run


def embedding_near_dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Near duplicates among vectors of one label: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding (array of numbers), label; other columns are
    ignored. One row per distinct (vec_id, label, embedding); rows without a
    vec_id are left out. Vectors link if their labels are equal and not null,
    their lengths are equal and their cosine is `cosine` or more; vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing. Equal vectors are one class: they all link, and are looked at once.
    Every pair returned is exact; of the pairs there are, those that share no
    cell in any table are missed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lattice")
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("label").alias("lh"), F.col("label").isNotNull().alias("labelled"), x.alias("x")).where("vec_id is not null")
    rows = rows.withColumn("fine", F.col("labelled") & F.col("x").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64("x", F.lit(1))})
    ids = scratch.write(rows.select("vec_id", "lh", "labelled", "fine", "h1", "h2").distinct(), "ids")
    classes = ids.where("fine").groupBy("lh", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = scratch.write(ids.where("fine").join(classes, ["lh", "h1", "h2"]).select("vec_id", "rep", "copies"), "members")
    # The vector of each class, from the row of its representative.
    same = ids.where("fine").join(classes, ["lh", "h1", "h2"]).where("vec_id = rep").select("lh", "h1", "h2", "rep", "copies")
    reps = rows.where("fine").withColumnRenamed("vec_id", "rep").join(same, ["rep", "lh", "h1", "h2"]).dropDuplicates(["rep", "lh", "h1", "h2"])
    reps = scratch.write(reps.select("rep", "lh", "copies", "x"), "reps")

    keys = scratch.write(reps.select("rep", "lh", "x").mapInArrow(_keys, "cell long, lh long, rep long, home boolean"), "keys")
    full = keys.groupBy("cell", "lh").agg(F.count(F.lit(1)).alias("rows"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("cell", "lh", "rows")
    met = scratch.write(keys.join(full, ["cell", "lh"]), "met")
    met = met.join(reps, ["rep", "lh"])
    found = scratch.write(deal(met, ["cell", "lh"], "rep", "rows", BLOCK).mapInArrow(_links(cosine), "rep long, links long, other long"), "links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    labels = scratch.write(connected_components(edges, scratch, "cc"), "labels").withColumnRenamed("node", "rep")
    scratch.drop("keys", "met")
    linked = members.join(links, "rep", "left").join(labels, "rep", "left")
    linked = linked.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = ids.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
