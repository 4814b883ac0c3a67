"""LM scoring: counts and base scores against plain Python, probabilities that add up to 1, gradients against differences, and what it learns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import lm as L
from lamina.llm.langid import held_out

KIND = "doc_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def naive(rows, train):
    """doc_id, n_tokens, n_known, N, base score."""
    count = Counter(w for i, t in rows if train(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        own = words(t)
        out.append((i, not train(i), len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)))
    return out


def corpus(n=1000, seed=1):
    """Two languages: the words of each text are of one of them."""
    r = random.Random(seed)
    kinds = [[a + b + c for b in "aeiou" for c in k] for a, k in (("b", "dgkt"), ("s", "lmnr"))]
    return [(i, " ".join(r.choice(kinds[i % 2])[: r.choice((3, 3, 3, 2))] + (r.choice("xyzwvq") if r.random() < 0.2 else "") for _ in range(60))) for i in range(n)]


def test_counts_and_base_scores(spark):
    rows = [(1, "The the tHE\tcat\x1cdog"), (2, None), (3, ""), (4, " \n "), (None, "cat É é"), (5, "word " * 5000), (5, "unknown"), (6, "ÀB ab"), (-7, "the cat"), *corpus(40)]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS score", "'x' AS train", "2 AS key").repartition(3)
    for chunk in (1, 200, L.CHUNK):
        got = sorted((tuple(r)[:6] for r in L.lm_score(df, held_out(7, 2), chunk).collect()), key=repr)
        want = sorted(naive(rows, train), key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(corpus(), KIND)
    return L.LanguageModel(df.select("*", (F.col("doc_id") % 3 != 0).alias("train")))


def test_probabilities_add_up(model):
    """Over all words that training held, the end, and one that it didn't."""
    s = model.shape
    known = Counter(w for i, t in corpus() if i % 3 for w in words(t))
    keys = {}
    for w in [*known, "never-seen"]:
        if w is not None:
            data = np.frombuffer(w.encode(), np.uint8)
            keys[w] = int(L._keys(data, np.array([0, len(data)]))[0][0])
    keys[None] = int(L.END)
    names = list(keys)
    assert s.distinct == len(known) and s.total == sum(known.values())
    for before in (["bad"], ["never-seen"], ["sal", "ser"], ["bad", "bed", "sal"]):
        tokens = np.array([[*(names.index(b) if b in names else names.index("never-seen") for b in before), k] for k in range(len(names))], np.int32)
        row = {"ids": [], "sizes": np.full(len(names), len(before) + 1, np.int32).tobytes(), "train": np.zeros(len(names), bool).tobytes()}
        row |= {"keys": np.array([keys[w] for w in names], np.int64).tobytes(), "totals": np.array([known[w] for w in names], np.int64).tobytes(), "tokens": L._squeezed(tokens.ravel())}
        p = np.exp(L.log_probs(model.weights, s, L.Coded(row, s)).reshape(tokens.shape)[:, -1])
        assert abs(p.sum() - 1) < 1e-4 and (p > 0).all()


def test_better_than_the_base_on_held_out(model):
    got = model.score().where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert (got[0] - got[1]) / got[2] > 0.2 and got[3] > 0.99


def test_order_matters(spark):
    """In every text a word is followed by its own successor: the pair features must tell it."""
    r = random.Random(2)
    letters = "abcdefgh"
    rows = []
    for i in range(400):
        k, out = r.randrange(8), []
        for _ in range(50):
            out.append(letters[k] * 3)
            k = (k * 3 + 1) % 8 if r.random() < 0.9 else r.randrange(8)
        rows.append((i, " ".join(out)))
    got = L.lm_score(spark.createDataFrame(rows, KIND), F.col("doc_id") % 4 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[1] / got[2] < -0.85 and got[0] / got[2] > -0.5


def test_gradient(model):
    """One step's sum of gradients against differences of the loss."""
    r = np.random.default_rng(3)
    w = model.weights
    n, classes = 40, model.shape.classes
    f64 = lambda v: r.normal(0, 0.3, v.shape)
    own = np.where(w.own > -1e8, w.own, -30).astype(float)
    own[:, :3] = 0
    now = L.Weights(w.shape, f64(w.base), f64(w.rows), w.seen, own, f64(w.slots), w.met)
    cls = r.integers(0, classes, n)
    slot = np.where(cls < model.shape.heads, r.integers(0, 3, n), -1)
    x = L.Batch(cls, slot, r.integers(0, 5, (n, 3)), r.integers(0, 5, (n, 1)))

    def loss():
        z, at, y = L._forward(now, x)
        return -(z[np.arange(n), cls].sum() + y[np.arange(len(at)), slot[at]].sum())

    z, at, y = L._forward(now, x)
    g, h = np.exp(z), np.exp(y)
    g[np.arange(n), cls] -= 1
    h[np.arange(len(at)), slot[at]] -= 1
    for table, rows, grad in ((now.rows, x.feats, g), (now.slots, x.inner[at], h)):
        seen = np.zeros(len(table))
        moved = table.copy()
        L._step(moved, seen, None, rows, grad)
        for i in range(5):
            for c in range(3):
                old = table[i, c]
                table[i, c] = old + 1e-5
                up = loss()
                table[i, c] = old - 1e-5
                want = (up - loss()) / 2e-5
                table[i, c] = old
                if seen[i]:
                    assert abs((old - moved[i, c]) / L.RATE * np.sqrt(seen[i] + 1e-6) - want) < 1e-4


def test_strides_make_no_difference(model, monkeypatch):
    """Features are the same however many documents are looked at together."""
    row = next(r for r in model.coded.toLocalIterator() if r["ids"]).asDict()
    want = L.log_probs(model.weights, model.shape, L.Coded(row, model.shape))
    monkeypatch.setattr(L, "STRIDE", 100)
    assert np.allclose(L.log_probs(model.weights, model.shape, L.Coded(row, model.shape)), want, atol=1e-5)
    n = np.array([0, 5, 70_000, 2**31 - 1], np.int32)
    assert (L._spread(L._squeezed(n), 4) == n).all() and len(L._spread(L._squeezed(n[:0]), 0)) == 0


def test_as_often_as_one_likes(spark):
    """The same input gives the same scores, whatever order tasks end in."""
    df = spark.createDataFrame(corpus(120), KIND).repartition(6, "doc_id")
    a, b = ([tuple(r) for r in L.lm_score(df, held_out(7, 2), 300).orderBy("doc_id").collect()] for _ in range(2))
    assert a == b


def test_nothing_to_learn_from(spark):
    assert L.lm_score(spark.createDataFrame([], KIND), held_out(7, 2)).collect() == []
    got = L.lm_score(spark.createDataFrame([(1, "a b"), (2, None)], KIND), F.lit(True)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    got = L.lm_score(spark.createDataFrame([(1, None), (2, "a")], KIND), F.col("doc_id") == 2).orderBy("doc_id").collect()
    assert got[0].score < 0 and got[1].n_known == 1
