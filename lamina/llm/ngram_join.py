"""N-gram Jaccard join: an exact metric-space self join on word-shingle sets.

Distance is 1 - Jaccard. The pivots are one-shingle sets {s}: a document x with
s in it lies at 1 - 1/|x| from the pivot, every other document at distance 1.
A document's Voronoi region is that of its first shingle in one global order;
the triangle inequality bounds how far a partner's first shared shingle can lie
down that order: |x - y| <= r |x| for d(x, y) <= r, so x is copied into the
regions of its first floor(r |x|) + 1 shingles and no further (its window), and
every linked pair meets in a region. Document pivots can't do this: unrelated
documents all lie at distance exactly 1 from any of them, so each window would
hold every document.

The order puts frequent shingles last, as counted over the whole corpus by a
sketch of fixed size; it steers cost only, any order gives the same links.

Regions then join in ROUNDS rounds, which is one. A round takes one document of every region as
pivot, verifies the region's documents of other components against it (a star,
not all pairs), and merges components. Documents of one component need no
further pair between them. What is left after the rounds, pairs of different
components in one region, is compared in full, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .blocks import deal, pairs, runs
from .shared import Scratch, connected_components, tidy

THRESHOLD = 80  # per cent
WIDTH = 5
#: Rows of a region that are compared in one block.
BLOCK = 512
ROUNDS = 1
#: Slots of the sketch of shingle counts, for each document, and least and most of them (a byte each is broadcast).
SKETCH, SKETCH_LEAST, SKETCH_MOST = 16, 1 << 16, 1 << 24
SKETCH_BLOCK = 1 << 14
#: Bits of a set's parity signature.
PARITY = 1024
#: Level from which a shingle's region is dealt by hash of the document, for its size has no bound.
HOT = 5


def _sets(batch: pa.RecordBatch):
    """(row of the batch, sorted distinct shingle hashes), in slices: rows lo..hi and the two arrays."""
    for lo, hi, data, off in K.pieces(batch.column("text")):
        r, s = K.shingles(data, off, WIDTH)
        yield lo, hi, r, s


def _profile(slots: int):
    @K.lean
    def run(batches):
        counts = np.zeros(slots, np.int32)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, r, s in _sets(batch):
                n = np.bincount(r, minlength=hi - lo)
                slot, more = np.unique((s & np.uint64(slots - 1)).astype(np.int64), return_counts=True)
                counts[slot] += more.astype(np.int32)
                h = np.zeros((2, hi - lo), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    h[0, full] = np.add.reduceat(K.mix(s), at)
                    h[1, full] = np.add.reduceat(K.mix(s ^ np.uint64(0x5DEECE66D1234567)), at)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(n.astype(np.int64)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=names)
        # A partition's count of a slot stops at 255: such a slot stands out all the same.
        for i, c in enumerate(np.minimum(counts, 255).astype(np.uint8).reshape(-1, SKETCH_BLOCK)):
            if c.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=names)

    names = ["doc_id", "n", "h1", "h2", "block", "counts"]
    return run


@K.lean
def _summed(batches):
    """Adds up the sketch blocks of a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(c.as_buffer(), np.uint8).astype(np.int32)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["block", "counts"])


def prefix_size(n, threshold: int = THRESHOLD):
    """Regions of a set of n: one more than the shingles that a partner may lack."""
    return n - (threshold * n + 99) // 100 + 1


def _postings(levels, threshold: int):
    """Region rows (s, doc_id, n, place, hot) of each document's window; the first of equal sets in a partition stands for them."""

    def run(batches):
        level, seen = levels.value, set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, r, s in _sets(batch):
                n = np.bincount(r, minlength=hi - lo)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                at = (np.cumsum(n) - n)[full]
                key = np.add.reduceat(K.mix(s), at).tolist()
                new = np.zeros(hi - lo, bool)
                for i, k in zip(full.tolist(), key, strict=True):
                    if k not in seen:
                        seen.add(k)
                        new[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                hot = level[(s & np.uint64(len(level) - 1)).astype(np.int64)]
                size = prefix_size(n, threshold)
                # Within a row shingles are in order of s; those of level 0 come first.
                plain = np.cumsum(hot == 0)
                plain -= np.repeat(plain[at] - (hot[at] == 0), n[full])
                short = np.zeros(hi - lo, bool)
                short[full] = np.add.reduceat((hot == 0).astype(np.int64), at) < size[full]
                take = np.flatnonzero((hot == 0) & (plain <= size[r]) & new[r] & ~short[r])
                place = plain[take] - 1
                rest = np.flatnonzero((short & new)[r])
                if len(rest):
                    order = rest[np.lexsort((s[rest], hot[rest], r[rest]))]
                    own = r[order]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    at_rest = np.arange(len(own)) - np.repeat(first, n[own[first]])
                    ok = at_rest < size[own]
                    take, place = np.concatenate([take, order[ok]]), np.concatenate([place, at_rest[ok]])
                yield pa.RecordBatch.from_arrays([pa.array(s[take].view(np.int64)), pa.array(ids[lo:hi][r[take]]), pa.array(n[r[take]].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(hot[take] >= HOT)], names=["s", "doc_id", "n", "place", "hot"])

    return run


def _shared_only(threshold: int):
    """Drops rows of regions that have no partner of a fitting size there, from rows sorted by (s, n)."""

    def run(batches):
        for t in runs(batches, ["s"]):
            s, n, place = (t.column(c).to_numpy() for c in ("s", "n", "place"))
            n = n.astype(np.int64)
            same = s[1:] == s[:-1]
            # The smaller of a linked pair has its first shared shingle early enough for the larger one's size.
            up = np.zeros(len(s), bool)
            up[:-1] = same & ((100 + threshold) * (n[:-1] - place[:-1]) >= threshold * (n[:-1] + n[1:]))
            down = np.zeros(len(s), bool)
            down[1:] = same & (100 * n[:-1] >= threshold * n[1:])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            alive = np.logical_or.reduceat(up, first)
            keep = np.repeat(alive, np.diff(np.concatenate([first, [len(s)]]))) & (up | down)
            if keep.any():
                yield from t.filter(pa.array(keep)).to_batches()

    return run


def _pairs(threshold: int):
    """Pairs (a, b) of each block whose components differ and whose sizes, places and signatures allow a link."""

    def run(batches):
        for t in runs(batches, ["s", "i", "j"]):
            doc, n, place, component = (t.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "n", "place", "component"))
            parity = _parities(t.column("parity"))
            for i, j in pairs(t, ["s"]):
                # If this is their first shared shingle, what follows it must suffice for the overlap.
                after = np.minimum((n - place)[i], (n - place)[j])
                ok = (component[i] != component[j]) & ((100 + threshold) * after >= threshold * (n[i] + n[j]))
                i, j = i[ok], j[ok]
                for lo in range(0, len(i), 1 << 15):
                    a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                    ok = _may_link(parity[a], parity[b], n[a] + n[b], threshold)
                    a, b = doc[a[ok]], doc[b[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _chosen(bitmap, parity: bool):
    """Of the documents that a bitmap of fixed size lets through, the parity signatures (doc_id, n, parity) or the sets (doc_id, items)."""

    def run(batches):
        let = bitmap.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            slot = _slot_of(ids, len(let) * 8)
            batch = batch.filter(pa.array((let[slot >> 3] >> (slot & 7)) & 1 == 1))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, r, s in _sets(batch):
                n = np.bincount(r, minlength=hi - lo)
                if parity:
                    bits = np.bincount(r * PARITY + (K.mix(s) % np.uint64(PARITY)).astype(np.int64), minlength=(hi - lo) * PARITY) & 1
                    packed = [x.tobytes() for x in np.packbits(bits.astype(np.uint8).reshape(-1, PARITY), axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(n.astype(np.int32)), pa.array(packed, pa.binary())], names=["doc_id", "n", "parity"])
                else:
                    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.ListArray.from_arrays(pa.array(off), pa.array(s.view(np.int64)))], names=["doc_id", "items"])

    return run


#: Slots of the bitmap that spares documents without candidates a second shuffle: 512 KB, whatever the input.
BITMAP = 1 << 22


def _slot_of(ids: np.ndarray, size: int) -> np.ndarray:
    return (K.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)


def _bitmap(ids: DataFrame):
    """Which slots the ids fall into, as a broadcast of BITMAP bits."""

    def words(batches):
        own = np.zeros(BITMAP, bool)
        for b in batches:
            own[_slot_of(b.column("doc_id").to_numpy(zero_copy_only=False), BITMAP)] = True
        packed = np.packbits(own, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["word", "bits"])

    got = ids.select("doc_id").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    packed = np.zeros(BITMAP // 64, np.int64)
    packed[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(packed.view(np.uint8))


def _parities(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY // 64)


def _may_link(x: np.ndarray, y: np.ndarray, size: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs that their parity signatures don't rule out; size: the sum of both sets' sizes.

    Signatures differ in at most as many bits as the sets in elements, so more
    bits than a link allows prove that there is none.
    """
    far = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return (100 + threshold) * far <= (100 - threshold) * size.astype(np.int64)


def _screened(pairs: DataFrame, signs: DataFrame, threshold: int) -> DataFrame:
    @K.lean
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                size = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
                ok = _may_link(_parities(batch.column("pa")), _parities(batch.column("pb")), size, threshold)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    for c in "ab":
        pairs = pairs.join(signs.select(F.col("doc_id").alias(c), F.col("n").alias("n" + c), F.col("parity").alias("p" + c)), c)
    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) at or over the threshold, by exact intersection.

    Each side's sets are made anew from the texts, so that none is stored.
    """
    a, b = (docs.mapInArrow(_chosen(_bitmap(pairs.select(F.col(c).alias("doc_id"))), False), "doc_id long, items array<long>").select(F.col("doc_id").alias(c), F.col("items").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def ngram_jaccard_join(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Joins documents whose 5-word shingle sets have a Jaccard similarity of threshold per cent or more.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id,
    n_shingles, component_id, one row per doc_id. Words are runs of characters
    other than space and tab to carriage return, A-Z in lower case; a text of
    one to four words has one shingle, of all its words. Null and empty texts
    and texts without words have none and link with nothing. Rows without a
    doc_id are left out. Rows that share a doc_id are one node, linked by any
    of its texts, with the largest n_shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    slots = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << (SKETCH * docs.count()).bit_length()))
    sketch = scratch.write(docs.mapInArrow(_profile(slots), "doc_id long, n long, h1 long, h2 long, block int, counts binary"), "profile")
    found = sketch.where("block is null").select("doc_id", "n", "h1", "h2")

    # The sketch, by levels of how far a slot's count stands out.
    counts = np.zeros((slots // SKETCH_BLOCK, SKETCH_BLOCK), np.int32)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    for row in sketch.where("block is not null").select("block", "counts").repartition(parts, "block").mapInArrow(_summed, "block int, counts binary").toLocalIterator():
        counts[row.block] = np.frombuffer(row.counts, np.int32)
    counts = counts.ravel()
    step = 2 * np.sqrt(counts.mean()) + 2
    levels = np.ceil(np.log2(np.maximum((counts - counts.mean()) / step, 1))).astype(np.uint8)
    levels = spark.sparkContext.broadcast(levels)

    # Equal sets: one edge from each copy to the first of its class.
    full = found.where("n > 0")
    first = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z")
    copies = full.select(F.col("doc_id").alias("b"), "n", "h1", "h2").join(first, ["n", "h1", "h2"]).select("a", "b").where("a < b").distinct()
    copies = scratch.write(copies, "copies")

    posted = docs.mapInArrow(_postings(levels, threshold), "s long, doc_id long, n int, place int, hot boolean")
    posted = scratch.write(posted.where("not hot").repartition(parts, "s").sortWithinPartitions("s", "n").mapInArrow(_shared_only(threshold), posted.schema).unionByName(posted.where("hot")).drop("hot"), "posted")
    tidy(spark)

    links = signs = None
    for turn in range(ROUNDS + 1):
        # Copies are stars already.
        labels = connected_components(links, scratch, f"cc{turn}-") if turn else copies.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(copies.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        labels = scratch.write(labels, f"labels{turn}")
        here = posted.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = here.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows"), F.min_by(F.struct("doc_id", "component", "n"), F.xxhash64("doc_id", F.lit(turn))).alias("p")).where("lo < hi")
        here = scratch.write(here.join(mixed.drop("lo", "hi"), "s"), f"mixed{turn}")
        tidy(spark)
        fits = F.lit(100) * F.least("n", "p.n") >= F.lit(threshold) * F.greatest("n", "p.n")
        if signs is None:
            # Every later candidate is in a mixed region of the first turn.
            signs = scratch.write(docs.mapInArrow(_chosen(_bitmap(here.select("doc_id")), True), "doc_id long, n int, parity binary"), "signs")
        if turn < ROUNDS:
            near = here.where(F.col("component") != F.col("p.component")).where(fits).select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct()
            near = _screened(near, signs, threshold)
        else:
            rows = here.select("s", "doc_id", "n", "place", "component", "rows").join(signs.select("doc_id", "parity"), "doc_id")
            near = deal(rows, ["s"], "doc_id", "rows", BLOCK).mapInArrow(_pairs(threshold), "a long, b long").distinct()
        near = scratch.write(near, f"near{turn}")
        tidy(spark)
        scratch.drop(f"mixed{turn}")
        links = scratch.write(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(_verified(near, docs, threshold)), f"links{turn}")
        scratch.drop(f"near{turn}")
        tidy(spark)
    labels = scratch.write(connected_components(links, scratch, "cc-"), "labels")
    scratch.drop("posted", "signs", "copies", *(f"{x}{i}" for x in ("links", "labels") for i in range(ROUNDS + 1)))
    profile = found.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    found = profile.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
