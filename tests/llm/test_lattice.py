import numpy as np
import pytest

from lamina.llm.lattice import cells, e8, embedding_near_dedup


def test_e8_decodes_to_nearest_points():
    r = np.random.default_rng(1)
    x = r.normal(0, 1.5, (300, 8))
    near, other, gap = e8(x)
    for p in (near, other):
        whole = np.isclose(p, np.rint(p)).all(1)
        half = np.isclose(p - 0.5, np.rint(p - 0.5)).all(1)
        assert (whole | half).all() and (np.rint(p.sum(1)) % 2 == 0).all()
    assert (((x - near) ** 2).sum(1) <= 1.0 + 1e-9).all() and (gap >= 0).all()


def brute(rows, least=0.98):
    ok = {}
    for i, v, l in rows:
        if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v) / np.abs(v).max()
            ok[i] = (v / np.linalg.norm(v), l)
    n, comp = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= least:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in n}


def test_recall_and_exactness(spark):
    r = np.random.default_rng(2)
    rows = []
    for g in range(60):
        base = r.normal(size=64)
        for _ in range(r.integers(1, 6)):
            rows.append((len(rows), (base + r.normal(0, 0.1, 64)).tolist(), int(g % 3)))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(3)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute(rows)
    links = sum(n for n, *_ in want.values())
    assert links > 200 and sum(n for n, *_ in got.values()) >= 0.9 * links
    assert all(got[i][0] <= want[i][0] for i in want)


@pytest.mark.parametrize("dims", [3, 8, 64, 384, 768])
def test_cells_at_any_length(dims):
    """At the threshold nearly all pairs meet, and few unrelated ones do, but in spaces too small for that."""
    r = np.random.default_rng(3)
    a, t = r.normal(size=(2, 1200, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    t -= (t * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * t / np.linalg.norm(t, axis=1, keepdims=True)

    def meet(x, y):
        (hx, px), (hy, py) = x, y
        return ((hx == hy) | (hx == py) | (px == hy)).any(1).mean()

    ca, cb = cells(a), cells(b)
    assert meet(ca, cb) >= 0.97
    order = r.permutation(1200)
    assert dims < 8 or meet(ca, tuple(c[order] for c in ca)) < 0.01


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 1.0], None), (6, [1.0, 1.0], 1), (7, [2.0, 2.0], 1), (8, [1.0, 1.0], 2), (9, [1.0, 1.0, 0.0], 1), (10, [], 1), (11, [1e200, 1e200], 1), (6, [1.0, 1.0], 1)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS links", "3 AS cell")).collect()}
    assert got == brute([r for k, r in enumerate(rows) if k < 11])
    assert embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
