import random
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lamina.llm import textkernel as K
from lamina.llm import toxicity as toxicity_module
from lamina.llm.langid import held_out
from lamina.llm.toxicity import FILTERS, THRESHOLD, Classifier, fit, sample, toxicity


def corpus(n=900, seed=4):
    r = random.Random(seed)
    syll = ["ha", "re", "tion", "ing", "the", "an", "on", "er", "st", "nd"]
    docs, labels = [], []
    for i in range(n):
        w = ["".join(r.choice(syll) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vermin", "zzqu" + r.choice(syll), "Vermin"]))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_quality(spark):
    d, l = corpus()
    docs, labels = spark.createDataFrame(d, "doc_id long, text string, lang string"), spark.createDataFrame(l, "doc_id long, toxic int")
    model = fit(sample(docs, labels.where(~held_out(3, 1))).collect())
    out = toxicity(docs, model).join(labels, "doc_id").where(held_out(3, 1)).toPandas()
    assert ((out.score >= THRESHOLD) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    bad, good = out[out.toxic == 1], out[out.toxic == 0]
    assert bad.predicted.mean() > 0.85 and good.predicted.mean() < 0.05


Row = namedtuple("Row", "doc_id toxic order lang words")


def rows_of(texts, toxic):
    out = []
    for lo, hi, data, off in K.pieces(pa.array(texts)):
        row, f = toxicity_module._features(data, off)
        out += [Row(lo + i, toxic[lo + i], lo + i, "en", f[row == i].astype("<u2").tobytes()) for i in range(hi - lo)]
    return out


def test_order_matters():
    """A pair of words in one order is toxic, the same words apart or the other way round are not: filters of width 2 learn it."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]

    def text(kind):
        w = [r.choice(words) for _ in range(r.randint(8, 20))]
        k = r.randrange(len(w))
        return " ".join(w[:k] + {0: ["kindle", "matter"], 1: ["matter", "kindle"], 2: ["kindle", r.choice(words), r.choice(words), "matter"]}[kind] + w[k:])

    kinds = [0 if i % 2 else 1 + i // 2 % 2 for i in range(3000)]
    model = fit(rows_of([text(k) for k in kinds], [int(k == 0) for k in kinds]))
    test = [k % 3 for k in range(600)]
    got = []
    for row in rows_of([text(k) for k in test], test):
        f = np.frombuffer(row.words, "<u2").astype(np.int64).reshape(-1, 3)
        got.append(model.score(np.zeros(len(f), np.int64), f, 1)[0] >= THRESHOLD)
    right = np.mean([g == (k == 0) for g, k in zip(got, test, strict=True)])
    assert right > 0.9


def test_forward_pass_equals_a_plain_one():
    """Scores of several texts at once against loops over places and filters."""
    r = np.random.default_rng(8)
    filters, cols = sum(FILTERS.values()), sum(w * c for w, c in FILTERS.items())
    m = Classifier(r.normal(size=(toxicity_module.BUCKETS, cols + 2)).astype(np.float32), r.normal(size=filters), r.normal(size=filters + 1), r.normal(size=2))
    texts = [r.integers(0, toxicity_module.BUCKETS, (n, 3)) for n in (1, 2, 3, 7, 40)]
    got = m.score(np.repeat(np.arange(5), [len(t) for t in texts]), np.concatenate(texts), 5)
    for t, s in zip(texts, got, strict=True):
        g = m.table[t].sum(1)
        pooled, col = [], 0
        for width, count in FILTERS.items():
            for k in range(count):
                acts = [sum(g[p + j, col + j * count + k] for j in range(width)) for p in range(len(t) - width + 1)]
                pooled.append(max(0.0, max(acts) + m.bias[len(pooled)]) if acts else 0.0)
            col += width * count
        z = np.dot(pooled, m.out[:-1]) + m.out[-1] + m.shift[g[:, -2:].sum(0).argmax()]
        assert np.isclose(s, 1 / (1 + np.exp(-np.clip(z, -40, 40))), atol=1e-5)


def test_odd_rows_and_no_labels(spark):
    d, l = corpus(120)
    docs, labels = spark.createDataFrame(d, "doc_id long, text string, lang string"), spark.createDataFrame([*l, (None, 1), (3, None)], "doc_id long, toxic int")
    model = fit(sample(docs, labels, 20).collect())
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "the " * 50_000), (None, "vermin"), (4, "the " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "predicted": F.lit(7), "toxic": F.lit(1)})
    out = toxicity(df, model).collect()
    assert len(out) == len(rows) and out[0].score == out[1].score == out[2].score
    none = spark.createDataFrame([], "doc_id long, toxic int")
    empty = fit(sample(docs, none).collect())
    assert {r.predicted for r in toxicity(docs, empty).collect()} == {0}
    assert toxicity(docs.limit(0), model).collect() == []
