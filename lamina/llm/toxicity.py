"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three hashed ones: of the word, its first four
and its first five bytes. Filters of widths 1, 2 and 3 run over the words of a
text, the largest response of each is kept, and a logistic layer scores them.
Scores are shifted so that 0.7 is the threshold calibrated for the language that
the text's own words suggest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from . import textkernel as K

BUCKETS = 1 << 15
DIM = 8
#: Filters by width.
FILTERS = {1: 8, 2: 4, 3: 4}
#: The classifier is fitted on at most so many labelled documents of each class, taken by a hash of doc_id.
SAMPLE = 4000
#: Documents of more words aren't used to fit (all are scored whole).
LONGEST = 3000
THRESHOLD = 0.7
EPOCHS = 8
#: Spread of the first embeddings and filters, and the step of their training.
START, RATE = 0.1, 0.01
#: Toxic documents of a language that its own threshold takes; with fewer the common one holds.
LEAST = 12


def _features(data: np.ndarray, off: np.ndarray):
    """(row of each word, three buckets of each word)."""
    a, b, row = K.spans(data, off, K.letters(data))
    low = K.folded(data)
    cols = [K.hash_runs(low, a, np.minimum(b, a + n) if n else b) for n in (0, 4, 5)]
    f = np.stack([(K.mix(h + np.uint64(7 * k + 1)) % np.uint64(BUCKETS)).astype(np.int32) for k, h in enumerate(cols)], 1)
    return row, f


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE):
    """Features, labels and languages of at most `most` labelled documents of each class.

    The ids are chosen first, from narrow rows; the chosen ones, so a bounded
    number, are then broadcast. A document with several labels counts as toxic
    if any says so.
    """
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.withColumn("order", F.xxhash64("doc_id", F.lit(5)))
    chosen = None
    for c in (0, 1):
        part = ids.where(F.col("toxic") == c).orderBy("order").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "order", "lang", "text")

    def run(batches):
        for batch in batches:
            keep, feats = [], []
            for lo, hi, data, off in K.pieces(batch.column("text"), 1 << 19):
                row, f = _features(data, off)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    if 0 < cut[i + 1] - cut[i] <= LONGEST:
                        keep.append(lo + i)
                        feats.append(f[cut[i] : cut[i + 1]].astype("<u2").tobytes())
            own = batch.select(["doc_id", "toxic", "order", "lang"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(feats, pa.binary())], names=["doc_id", "toxic", "order", "lang", "words"])

    return rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "order", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "doc_id long, toxic int, order long, lang string, words binary")


@dataclass
class Classifier:
    table: np.ndarray  # BUCKETS x (responses of each filter's places, then languages)
    bias: np.ndarray  # of the filters
    out: np.ndarray  # logistic weights, the constant last
    shift: np.ndarray  # logit that maps each language's threshold to THRESHOLD

    def score(self, row: np.ndarray, f: np.ndarray, rows: int) -> np.ndarray:
        """Scores of rows texts; a text without words gets the score of no response."""
        pooled, lang = np.zeros((rows, len(self.bias))), np.zeros((rows, len(self.shift)))
        if len(row):
            g = self.table[f[:, 0]]
            g += self.table[f[:, 1]]
            g += self.table[f[:, 2]]
            pooled, _ = _pool(g, row, rows, self.bias, False)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            lang[row[first]] = np.add.reduceat(g[:, -len(self.shift) :], first, axis=0, dtype=np.float64)
        z = pooled @ self.out[:-1] + self.out[-1] + self.shift[lang.argmax(1)]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pool(g: np.ndarray, row: np.ndarray, rows: int, bias: np.ndarray, places: bool = True):
    """Largest response over 0 of each filter in each text, and where it is (-1: none). g: place responses by word."""
    n = len(row)
    pooled, at = np.zeros((rows, len(bias))), np.full((rows, len(bias)), -1)
    col = out = 0
    for width, count in FILTERS.items():
        if n >= width:
            act = g[: n - width + 1, col : col + count].copy()
            for j in range(1, width):
                act += g[j : n - width + 1 + j, col + j * count : col + (j + 1) * count]
            own = row[: n - width + 1]
            whole = own == row[width - 1 :]
            act[~whole] = -1e9
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            top = np.maximum.reduceat(act, first, axis=0)
            to = own[first]
            pooled[to, out : out + count] = np.maximum(top + bias[out : out + count], 0)
            size = np.diff(np.concatenate([first, [len(own)]]))
            for k in range(count if places else 0):
                hit = np.flatnonzero(act[:, k] == np.repeat(top[:, k], size))
                r, i = np.unique(own[hit], return_index=True)
                at[r, out + k] = hit[i]
            at[to, out : out + count] = np.where(pooled[to, out : out + count] > 0, at[to, out : out + count], -1)
        col += width * count
        out += count
    return pooled, at


def fit(rows: list, seed: int = 3) -> Classifier:
    """The classifier from sampled rows (toxic, order, lang, words); a fifth of them calibrate the thresholds.

    Without rows of both classes every score is the same, under the threshold.
    """
    rng = np.random.default_rng(seed)
    rows = sorted(rows, key=lambda r: (r.order, r.doc_id))
    y = np.array([r.toxic > 0 for r in rows], float)
    docs = [np.frombuffer(r.words, "<u2").astype(np.int64).reshape(-1, 3) for r in rows]
    langs = sorted({r.lang for r in rows if r.lang is not None}) or [""]
    held = np.arange(len(rows)) % 5 == 4
    filters = sum(FILTERS.values())
    cols = sum(w * c for w, c in FILTERS.items())

    # Language hints: log probability of each bucket by language, over the sample.
    hint = np.full((BUCKETS, len(langs)), 0.5)
    for r, d in zip(rows, docs, strict=True):
        if r.lang is not None:
            np.add.at(hint[:, langs.index(r.lang)], d.ravel(), 1)
    hint = np.log(hint / hint.sum(0))

    if not (0 < y[~held].sum() < (~held).sum()):
        return Classifier(np.concatenate([np.zeros((BUCKETS, cols)), hint], 1).astype(np.float32), np.zeros(filters), np.append(np.zeros(filters), -2.0), np.zeros(len(langs)))

    # Everything starts at random; what a word or a run of words is worth is learned.
    emb = rng.normal(0, START, (BUCKETS, DIM))
    conv = rng.normal(0, START, (DIM, cols))
    bias = np.zeros(filters)
    out = np.append(rng.normal(0, 0.3, filters), -1.0)

    owner = np.concatenate([np.full(c, w) for w, c in FILTERS.items()])
    base = {}
    col = k = 0
    for width, count in FILTERS.items():
        for i in range(count):
            base[k + i] = [col + j * count + i for j in range(width)]
        col += width * count
        k += count

    params = {"emb": emb, "conv": conv, "bias": bias, "out": out}
    mean = {n: np.zeros_like(p) for n, p in params.items()}
    var = {n: np.zeros_like(p) for n, p in params.items()}
    step = 0
    learn = np.flatnonzero(~held)
    weight = np.where(y > 0, 0.5 / max(1, y[~held].mean() * len(learn)), 0.5 / max(1, (1 - y[~held]).sum())) * len(learn)
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for lo in range(0, len(learn), 64):
            batch = learn[lo : lo + 64]
            f = np.concatenate([docs[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(docs[i]) for i in batch])
            e = emb[f].sum(1)
            pooled, at = _pool(e @ conv, row, len(batch), bias)
            z = pooled @ out[:-1] + out[-1]
            dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[batch]) * weight[batch] / len(batch)
            grad = {"out": np.append(pooled.T @ dz, dz.sum()), "bias": np.zeros(filters), "conv": np.zeros_like(conv), "emb": {}}
            dp = dz[:, None] * out[:-1]
            where, what = [], []
            for k in range(filters):
                r = np.flatnonzero(at[:, k] >= 0)
                if not len(r):
                    continue
                d = dp[r, k]
                grad["bias"][k] += d.sum()
                for j in range(owner[k]):
                    w, c = at[r, k] + j, base[k][j]
                    grad["conv"][:, c] += e[w].T @ d
                    where.append(w)
                    what.append(d[:, None] * conv[:, c])
            step += 1
            for n in ("out", "bias", "conv"):
                _adam(params[n], grad[n], mean[n], var[n], step, RATE)
            if where:
                w, g = np.concatenate(where), np.concatenate(what)
                touched, inverse = np.unique(f[w].ravel(), return_inverse=True)
                ge = np.zeros((len(touched), DIM))
                np.add.at(ge, inverse, np.repeat(g, 3, 0))
                m, v, p = mean["emb"][touched], var["emb"][touched], emb[touched]
                _adam(p, ge, m, v, step, RATE)
                emb[touched], mean["emb"][touched], var["emb"][touched] = p, m, v

    model = Classifier(np.concatenate([emb @ conv, hint], 1).astype(np.float32), bias, out, np.zeros(len(langs)))
    _calibrate(model, [docs[i] for i in np.flatnonzero(held)], y[held])
    return model


def _adam(p, g, m, v, step, rate):
    m *= 0.9
    m += 0.1 * g
    v *= 0.999
    v += 0.001 * g * g
    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _calibrate(model: Classifier, docs: list[np.ndarray], y: np.ndarray) -> None:
    """Sets each language's shift: its threshold lies where balanced errors on the calibration documents are fewest."""
    z, lang = np.zeros(len(docs)), np.zeros(len(docs), int)
    for i, d in enumerate(docs):
        s = model.score(np.zeros(len(d), np.int64), d, 1)[0]
        z[i] = np.log(s / (1 - s))
        lang[i] = model.table[:, -len(model.shift) :][d].sum((0, 1)).argmax()

    def threshold(z, y):
        order = np.argsort(z)
        z, y = z[order], y[order]
        cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        # Documents under the cut are passed; a clean one lost counts as twice a toxic one kept.
        missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
        lost = (len(y) - y.sum() - np.concatenate([[0], np.cumsum(1 - y)])) / max(1, len(y) - y.sum())
        cost = missed + 2 * lost
        best = np.flatnonzero(cost == cost.min())
        return float(cuts[best[len(best) // 2]])

    if not (0 < y.sum() < len(y)):
        return
    goal = np.log(THRESHOLD / (1 - THRESHOLD))
    common = threshold(z, y)
    for k in range(len(model.shift)):
        own = lang == k
        enough = y[own].sum() >= LEAST and (1 - y[own]).sum() >= LEAST
        model.shift[k] = goal - (threshold(z[own], y[own]) if enough else common)


def toxicity(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of every whole text, one row per input row, and the columns named in keep.

    predicted is 1 from a score of THRESHOLD on. Null, empty and wordless texts
    get the score of a text without any response.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            score = [np.zeros(0)]
            for lo, hi, data, off in K.pieces(batch.column("text"), 1 << 18):
                row, f = _features(data, off)
                score.append(model.score(row, f, hi - lo))
            s = np.concatenate(score)
            out = [batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*out, *(batch.column(c) for c in keep)], names=["doc_id", "score", "predicted", *keep])

    kind = StructType([*_parse_datatype_string("doc_id long, score double, predicted int").fields, *(docs.schema[c] for c in keep)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys(("text", *keep))).mapInArrow(run, kind)
