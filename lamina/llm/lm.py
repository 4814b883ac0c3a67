"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class, given features of the tokens before
it, times its own within the class. Frequent words have classes of up to SLOTS
words, whose softmax sees features too; the others fall into one tail class for
each kind of word, where discounted counts decide; what training documents never
held is one outcome, and words that they hold once stand for it when the model
is trained. Kinds are clusters of words by what stands before them. Outcomes are
the V words and the unseen one, and their probabilities add up to 1.

Features are the previous token, the one before it alone (a skip), and the two
together; frequent words have rows of their own, others one for their ending,
and pairs are hashed. Within a class the feature is the previous token, hashed
with the class.

Training goes through all training tokens once, in ROUNDS of synchronous
updates: each task takes gradient steps from the current weights over its own
chunks, and each row of the weights moves by the mean of the tasks' moves,
weighted by how often they met its feature. Sums of a fixed size are all that
the driver sees of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counted
from . import textkernel as K
from .shared import Scratch

#: A chunk of documents is complete with so many tokens.
CHUNK = 1 << 21
#: Tokens whose features are made together, whole documents at least.
STRIDE = 1 << 17
#: Frequent words, words of a class, endings by hash (low bits of a key), kinds of words, and frequent words before which kinds are told.
HEAD, SLOTS, ENDINGS, KINDS, ANCHORS = 1024, 64, 1024, 8, 128
#: Rows for pairs of tokens, of class features and of word features.
PAIRS = 4096
ROUNDS = 4
BATCH, RATE = 1024, 0.25
SLICES = 64
# Keys of the end and of the start, which no word is likely to hash to.
END, START = np.int64(0x5851F42D4C957F2D), np.int64(0x14057B7EF767814F)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _keys(data: np.ndarray, off: np.ndarray):
    """Key of each token of the texts, ends included, and how many each text has."""
    a, b, row = K.spans(data, off, ~K.SPACES[data])
    ending = K.hash_runs(data, np.maximum(a, b - 3), b) & np.uint64(ENDINGS - 1)
    key = K.hash_runs(data, a, b) & ~np.uint64(ENDINGS - 1) | ending
    n = np.bincount(row, minlength=len(off) - 1) + 1
    out = np.full(int(n.sum()), END, np.int64)
    out[np.arange(len(a)) + row] = key.view(np.int64)
    return out, n


def _squeezed(numbers: np.ndarray) -> bytes:
    """Small 32-bit integers with their bytes by place, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def _spread(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd") if n else b"", np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4")[:, 0]


_CHUNK = "chunk long, keys binary, counts binary, ids array<long>, train binary, sizes binary, tokens binary"
_CODED = "chunk long, round int, keys binary, totals binary, ids array<long>, train binary, sizes binary, tokens binary"


def token_chunks(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of (doc_id, text, train): tokens as places in the chunk's list of keys, and training counts of these."""

    @K.lean
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        keys, ids, train, sizes, total = [], [], [], [], 0

        def row():
            all_keys, n = np.concatenate(keys), np.concatenate(sizes)
            own, local, times = np.unique(all_keys, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # small numbers for frequent words
            rank = np.empty(len(own), np.int32)
            rank[order] = np.arange(len(own), dtype=np.int32)
            tokens, learnt = rank[local], np.concatenate(train)
            counts = np.bincount(tokens[np.repeat(learnt, n)], minlength=len(own)).astype(np.int32)
            values = [part << 32 | number, own[order].tobytes(), counts.tobytes(), ids, learnt.tobytes(), n.astype(np.int32).tobytes(), _squeezed(tokens)]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _CHUNK.split(", ")])

        for batch in batches:
            doc_ids, learnt = batch.column("doc_id").to_pylist(), np.array(batch.column("train").to_pylist(), bool)
            for lo, hi, data, off in K.pieces(batch.column("text")):
                k, n = _keys(data, off)
                keys.append(k)
                sizes.append(n)
                ids += doc_ids[lo:hi]
                train.append(learnt[lo:hi])
                total += len(k)
                if total >= chunk:
                    yield row()
                    keys, ids, train, sizes, total = [], [], [], [], 0
                    number += 1
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train").mapInArrow(run, _CHUNK)


@dataclass
class Shape:
    """What counts alone decide: words, classes and masses."""

    total: int  # training tokens
    distinct: int
    discount: float
    head: np.ndarray  # keys of frequent words, sorted
    cls: np.ndarray  # class of each of them
    slot: np.ndarray
    ending: np.ndarray  # tail class of each ending
    mass: np.ndarray  # of each class: its words' discounted count if it is a tail class
    heads: int  # head classes come first, then KINDS tail classes, then the unseen word

    @property
    def classes(self) -> int:
        return self.heads + KINDS + 1

    @property
    def rows(self) -> int:
        return 2 * (HEAD + ENDINGS + 1) + PAIRS

    def entities(self, keys: np.ndarray) -> np.ndarray:
        """Number of a frequent word, or HEAD and the ending."""
        at = np.minimum(np.searchsorted(self.head, keys), max(0, len(self.head) - 1))
        found = self.head[at] == keys if len(self.head) else np.zeros(len(keys), bool)
        return np.where(found, at, HEAD + (keys & (ENDINGS - 1)))


@dataclass
class Weights:
    shape: Shape
    base: np.ndarray  # of classes
    rows: np.ndarray  # feature rows x classes
    seen: np.ndarray  # sum of squared steps by feature row, the last for base
    own: np.ndarray  # of words: head classes x SLOTS
    slots: np.ndarray  # (feature, class) rows x SLOTS
    met: np.ndarray  # as seen, for slots

    def arrays(self) -> list[np.ndarray]:
        return [self.base, self.rows, self.seen, self.slots, self.met]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class Batch:
    cls: np.ndarray
    slot: np.ndarray  # -1 outside head classes
    feats: np.ndarray  # tokens x 3 rows
    inner: np.ndarray  # tokens x 1 row of slots


def _before(values: np.ndarray, first: np.ndarray, back: int, start) -> np.ndarray:
    """The value `back` tokens before each token of its text, or start. first: places of texts' first tokens."""
    out = np.full_like(values, start)
    out[back:] = values[:-back]
    for k in range(back):
        at = first + k
        out[at[at < len(out)]] = start
    return out


class Coded:
    """A chunk's tokens as classes, slots and features."""

    def __init__(self, row: dict, shape: Shape):
        self.ids = row["ids"]
        self.sizes = np.frombuffer(row["sizes"], np.int32)
        self.train = np.frombuffer(row["train"], bool)
        keys, totals = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["totals"], np.int64)
        tokens = _spread(row["tokens"], int(self.sizes.sum()))
        self.tokens, self.totals, self.keys = tokens, totals, keys
        self.entity = shape.entities(keys)
        self.shape = shape

    def classes(self, training: bool) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot of each key; in training, words met once stand for unseen ones."""
        s = self.shape
        head = self.entity < HEAD
        at = np.where(head, self.entity, 0)
        tail = s.ending[self.keys & (ENDINGS - 1)]
        cls = np.where(head, s.cls[at], tail) if len(s.head) else tail
        unseen = (self.totals <= training) & ~head
        return np.where(unseen, s.classes - 1, cls), np.where(head & ~unseen, s.slot[at], -1) if len(s.head) else np.full(len(cls), -1)

    def batches(self, training: bool, size: int = BATCH):
        """The tokens of the chunk, size at a time; in training those of training documents alone."""
        cls_of, slot_of = self.classes(training)
        ends, doc, base = np.cumsum(self.sizes), 0, 0
        wide = HEAD + ENDINGS + 1
        last = np.uint64(PAIRS - 1)
        while doc < len(ends):
            stop = max(doc + 1, int(np.searchsorted(ends, base + STRIDE, "right")))
            upto = int(ends[stop - 1])
            tokens, sizes = self.tokens[base:upto], self.sizes[doc:stop]
            first = np.cumsum(sizes) - sizes
            entity, key = self.entity[tokens], self.keys[tokens]
            one, two = (_before(entity, first, k, HEAD + ENDINGS) for k in (1, 2))
            k1, k2 = (_before(key, first, k, START).view(np.uint64) for k in (1, 2))
            pair = K.mix(k1 * _A + k2 * _B) & last
            cls, slot = cls_of[tokens], slot_of[tokens]
            feats = np.stack([one, wide + two, 2 * wide + pair.astype(np.int64)], 1)
            c = cls.astype(np.uint64)
            inner = (K.mix(one.astype(np.uint64) * _A + c * _C) & last).astype(np.int64)[:, None]
            at = np.flatnonzero(np.repeat(self.train[doc:stop], sizes)) if training else np.arange(len(key))
            for lo in range(0, len(at), size):
                k = at[lo : lo + size]
                yield base + k, Batch(cls[k], slot[k], feats[k], inner[k])
            doc, base = stop, upto


def _forward(w: Weights, x: Batch):
    """Log probabilities of all classes, and of the slots for tokens of head classes (with their places)."""
    z = w.rows[x.feats[:, 0]]
    for j in range(1, x.feats.shape[1]):
        z += w.rows[x.feats[:, j]]
    z += w.base
    at = np.flatnonzero(x.slot >= 0)
    y = w.own[x.cls[at]]
    for j in range(x.inner.shape[1]):
        y += w.slots[x.inner[at, j]]
    return _log_softmax(z), at, _log_softmax(y)


def log_probs(w: Weights, s: Shape, c: Coded) -> np.ndarray:
    """Natural log probability of each token of a chunk."""
    own = np.zeros(len(c.tokens))
    share = np.maximum(c.totals - s.discount, 1e-9) / np.maximum(s.mass[s.ending[c.keys & (ENDINGS - 1)]], 1e-9)
    tail = np.log(share)[c.tokens]
    for k, x in c.batches(False):
        z, at, y = _forward(w, x)
        p = z[np.arange(len(k)), x.cls].astype(np.float64)
        p[at] += y[np.arange(len(at)), x.slot[at]]
        more = (x.slot < 0) & (x.cls < s.classes - 1)
        p[more] += tail[k[more]]
        own[k] = p
    return own


def _step(table: np.ndarray, seen: np.ndarray, touched: np.ndarray | None, rows: np.ndarray, g: np.ndarray) -> None:
    """A gradient step of the rows that a batch meets; rows: tokens x features, g: tokens x columns."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.add.reduceat(g[order // rows.shape[1]], at, axis=0)
    own = s[at]
    seen[own] += (total * total).sum(1)
    table[own] -= RATE * total / np.sqrt(seen[own, None] + 1e-6)
    if touched is not None:
        touched[own] += np.diff(np.concatenate([at, [len(s)]]))


def _train(w: Weights, chunks) -> list[np.ndarray]:
    """Steps over chunks from w; the moves of rows times how often they were met, and what was added to sums of squares."""
    base, rows, seen, slots, met = (v.copy() for v in w.arrays())
    now = Weights(w.shape, base, rows, seen, w.own, slots, met)
    row_n, slot_n, n = np.zeros(len(rows), np.float32), np.zeros(len(slots), np.float32), 0
    for chunk in chunks:
        for k, x in chunk.batches(True):
            z, at, y = _forward(now, x)
            g = np.exp(z)
            g[np.arange(len(k)), x.cls] -= 1
            _step(rows, seen[:-1], row_n, x.feats, g)
            total = g.sum(0)
            seen[-1] += float((total * total).sum())
            base -= RATE * total / np.sqrt(seen[-1] + 1e-6)
            if len(at):
                h = np.exp(y)
                h[np.arange(len(at)), x.slot[at]] -= 1
                _step(slots, met, slot_n, x.inner[at], h)
            n += len(k)
    return [(base - w.base) * n, (rows - w.rows) * row_n[:, None], seen - w.seen, (slots - w.slots) * slot_n[:, None], met - w.met, row_n, slot_n, np.array([n], np.float32)]


def _moved(w: Weights, total: np.ndarray) -> Weights:
    parts, at = [], 0
    for v in [*w.arrays(), np.zeros(len(w.rows)), np.zeros(len(w.slots)), np.zeros(1)]:
        parts.append(total[at : at + v.size].reshape(v.shape))
        at += v.size
    base, rows, seen, slots, met, row_n, slot_n, n = parts
    mean = lambda v, k: v / np.maximum(k, 1)
    return Weights(w.shape, w.base + mean(base, n[0]), w.rows + mean(rows, row_n[:, None]), w.seen + seen, w.own, w.slots + mean(slots, slot_n[:, None]), w.met + met)


def _rows(batches, shape: Shape):
    for batch in batches:
        for row in batch.to_pylist():
            yield Coded(row, shape)


def _kinds(profile: np.ndarray, k: int = KINDS, rounds: int = 25) -> np.ndarray:
    """Clusters of rows by the direction of their counts' roots, relative to what is usual; rows without counts are in the first."""
    x = np.sqrt(profile.astype(np.float64))
    weight = np.sqrt(profile.sum(1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    full = np.flatnonzero(weight > 0)
    kind = np.zeros(len(x), np.int64)
    if not len(full):
        return kind
    x -= np.average(x[full], axis=0, weights=weight[full])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.where(norm > 1e-12, x / np.maximum(norm, 1e-12), 0)
    centres = [x[full[np.argmax(weight[full])]]]
    while len(centres) < min(k, len(full)):  # the heaviest of those far from all centres
        far = 1 - (x[full] @ np.array(centres).T).max(1)
        centres.append(x[full[np.argmax(np.maximum(far, 0) * weight[full])]])
    c = np.array(centres)
    for _ in range(rounds):
        kind[full] = (x[full] @ c.T).argmax(1)
        for j in range(len(c)):
            own = full[kind[full] == j]
            if len(own):
                m = (x[own] * weight[own, None]).sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return kind


def _profile(coded: DataFrame, head: np.ndarray, rank: np.ndarray, scratch: Scratch) -> np.ndarray:
    """How often each of the most frequent words stands before each frequent word and each ending, in training documents."""
    shape = Shape(0, 0, 0.0, head, np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), np.zeros(ENDINGS, np.int64), np.zeros(1), 0)
    by_entity = np.full(HEAD + ENDINGS + 1, ANCHORS)
    by_entity[: len(rank)] = rank
    size = (HEAD + ENDINGS) * ANCHORS

    def run(batches):
        total = np.zeros(size, np.int64)
        for c in _rows(batches, shape):
            e = c.entity[c.tokens]
            first = np.cumsum(c.sizes) - c.sizes
            before = _before(e, first, 1, HEAD + ENDINGS)
            anchor = by_entity[before]
            ok = (anchor < ANCHORS) & np.repeat(c.train, c.sizes)
            total += np.bincount(e[ok] * ANCHORS + anchor[ok], minlength=size)
        yield counted.in_slices(total, SLICES, TaskContext.get().partitionId())

    return counted.summed(coded.mapInArrow(run, counted.PARTS), scratch, "profile", "<i8", size, SLICES).reshape(-1, ANCHORS)


class LanguageModel:
    """Counts, classes and weights learnt from the training documents of `docs` (doc_id, text, train)."""

    def __init__(self, docs: DataFrame, chunk: int = CHUNK, rounds: int = ROUNDS):
        self.scratch = scratch = Scratch(docs.sparkSession, "lm")
        chunks = scratch.write(token_chunks(docs, chunk), "chunks")
        total = scratch.write(counted.totals(chunks), "totals")

        def code(row, totals):
            names = [c.split()[0] for c in _CODED.split(", ")]
            row = row | {"round": row["chunk"] % 1_000_003 % rounds, "totals": totals.tobytes()}
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.table([pa.array([row[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)

        self.coded = scratch.write(counted.with_totals(chunks, total, ["total"], code, _CODED), "coded", by="round")
        self.shape = self._shape(total)
        scratch.drop("chunks", "totals")
        self.weights = self._weights(rounds) if self.shape.distinct else None

    def _shape(self, total: DataFrame) -> Shape:
        n, v, n1, n2 = total.agg(F.sum("total"), F.count(F.lit(1)), F.sum((F.col("total") == 1).cast("long")), F.sum((F.col("total") == 2).cast("long"))).first()
        discount = ((n1 or 0) + 1) / ((n1 or 0) + 2 * (n2 or 0) + 2)
        top = total.orderBy(F.desc("total"), "key").limit(HEAD).collect()
        top = [(r["key"], r["total"]) for r in top if r["total"] > 1]
        by_key = sorted(top)
        head, count = np.array([k for k, _ in by_key], np.int64), np.array([c for _, c in by_key], np.int64)
        mass, words = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for r in total.groupBy(F.expr(f"cast(key & {ENDINGS - 1} AS int)").alias("e")).agg(F.sum("total").alias("m"), F.count(F.lit(1)).alias("w")).collect():
            mass[r["e"]], words[r["e"]] = r["m"], r["w"]
        np.subtract.at(mass, head & (ENDINGS - 1), count)
        np.subtract.at(words, head & (ENDINGS - 1), 1)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(head), np.int64)
        rank[order] = np.arange(len(head))
        kind = _kinds(_profile(self.coded, head, np.minimum(rank, ANCHORS), self.scratch))
        cls, slot, heads = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), 0
        for g in range(KINDS):
            own = order[kind[order] == g]
            cls[own], slot[own] = heads + np.arange(len(own)) // SLOTS, np.arange(len(own)) % SLOTS
            heads += -(-len(own) // SLOTS)
        left = np.zeros(heads + KINDS + 1)
        np.add.at(left, cls, count)
        np.add.at(left, heads + kind[HEAD:], mass - discount * words)
        left[-1] = (n1 or 0) + 1
        self.own = np.full((max(heads, 1), SLOTS), -1e9, np.float32)
        if len(head):
            self.own[cls, slot] = np.log(count / left[cls])
        return Shape(n or 0, v, discount, head, cls, slot, heads + kind[HEAD:], left, heads)

    def _weights(self, rounds: int) -> Weights:
        s = self.shape
        base = np.log(np.maximum(s.mass, 1e-9) / s.mass.sum()).astype(np.float32)
        zeros = lambda *size: np.zeros(size, np.float32)
        w = Weights(s, base, zeros(s.rows, s.classes), zeros(s.rows + 1), self.own, zeros(PAIRS, SLOTS), zeros(PAIRS))
        size = sum(v.size for v in w.arrays()) + s.rows + PAIRS + 1
        for r in range(rounds):

            def run(batches, w=w):
                parts = _train(w, _rows(batches, w.shape))
                if parts[-1][0]:
                    yield counted.in_slices(np.concatenate([p.ravel() for p in parts]).astype("<f4"), SLICES, TaskContext.get().partitionId())

            w = _moved(w, counted.summed(self.coded.where(F.col("round") == r).mapInArrow(run, counted.PARTS), self.scratch, f"round{r}", "<f4", size, SLICES))
        return w

    def score(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
        w, s = self.weights, self.shape

        def run(batches):
            for c in _rows(batches, s):
                n = len(c.sizes)
                first = np.cumsum(c.sizes) - c.sizes
                base = np.log10((c.totals + 1) / (s.total + s.distinct + 1))[c.tokens]
                own = log_probs(w, s, c) if w is not None else np.zeros(len(c.tokens))
                sums = lambda v: np.add.reduceat(v, first)
                known = sums((c.totals > 0)[c.tokens].astype(np.int64))
                cols = [pa.array(c.ids, pa.int64()), pa.array(~c.train), pa.array(c.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(n, s.total, np.int64)), pa.array(sums(base)), pa.array(sums(own) / np.log(10))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return self.coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_score(docs: DataFrame, held_out: Column, chunk: int = CHUNK, rounds: int = ROUNDS) -> DataFrame:
    """Scores all whole texts by a model learnt from those for which held_out is false; one row per input row.

    Null counts as the empty text, which is its end alone. Rows without a doc_id
    are judged by held_out like others, null there counting as false. Equal rows
    count each for itself. Without training tokens every score is 0: the unseen
    word is all there is. Other columns are ignored.
    """
    return LanguageModel(docs.select("doc_id", "text", (~F.coalesce(held_out, F.lit(False))).alias("train")), chunk, rounds).score()
