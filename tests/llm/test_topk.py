import math

from lamina.llm import topk
from lamina.llm.topk import quantised, top_k


def brute(rows, qids, k):
    w = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in qids:
        if q in w:
            s = sorted((-sum(a * b for a, b in zip(w[q], w[c], strict=False)), c) for c in w if c != q)
            out += [(q, n + 1, c, -v) for n, (v, c) in enumerate(s[:k])]
    return sorted(out)


def test_ties_nulls_and_lengths(spark, monkeypatch):
    rows = [(i, [((i * 7 + d * 13) % 11 - 5) / 4 for d in range(6)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf"), 1.0]), (104, []), (105, [0.5]), (None, [1.0])]
    v = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank"))
    monkeypatch.setattr(topk, "QUERIES", 3)
    got = sorted(map(tuple, top_k(v, v.where("vec_id % 5 = 0"), 4).collect()))
    assert got == brute(rows, [i for i, _ in rows if i is not None and i % 5 == 0], 4)


def test_large_weights_and_few_candidates(spark):
    rows = [(0, [1e9, -1e9]), (1, [1e9, 1e9]), (2, [1e300, 0.0])]
    v = quantised(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in top_k(v, v.where("vec_id = 0"), 10).collect()] == [(0, 1, 1, 0)]
    assert top_k(v.limit(0), v.limit(0)).collect() == []
