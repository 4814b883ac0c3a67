"""The join against brute force over literal sets."""

import random
import re

import numpy as np
import pyarrow as pa

from lamina.llm import blocks
from lamina.llm import textkernel as K
from lamina.llm import ngram_join as ngram_join_module
from lamina.llm.ngram_join import ngram_jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, threshold=80):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(seed):
    """Random texts, chains of edits, exact copies and a passage that many share."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 120))]
        if r.random() < 0.5:
            base = passage + base[: r.randint(1, 40)]
        rows.append(base)
        for _ in range(r.randint(0, 6)):
            base = base[:]
            for _ in range(r.randint(0, 2)):
                base[r.randrange(len(base))] = r.choice(words)
            rows.append(base)
    r.shuffle(rows)
    return [(i, " ".join(b)) for i, b in enumerate(rows)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = result(ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
        want = brute(rows)
        assert got == want
        assert len({c for _, c in want.values()}) < len(rows)


def test_odd_rows(spark, docs_kind):
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n\v\f\r ", "en", "s", 0),
        (4, "One two THREE", "en", "s", 0),
        (5, "one\ttwo  three", "de", None, 0),
        (6, "a b c d é", "en", "s", 0),
        (7, "a b c d É", "en", "s", 0),
        (8, "x " * 30_000, "en", "s", 0),
        (9, "x " * 40_000, "en", "s", 0),
        (None, "one two three", "en", "s", 0),
        (5, "one two three", "en", "s", 0),
        (10, " a b", "en", "s", 0),
    ]
    df = spark.createDataFrame(rows, docs_kind).selectExpr("*", "1 AS n", "2 AS s", "3 AS component")
    got = result(ngram_jaccard_join(df))
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 8), 9: (1, 8), 10: (1, 10)}


def test_empty_table(spark, docs_kind):
    assert ngram_jaccard_join(spark.createDataFrame([], docs_kind)).collect() == []


def test_threshold_is_exact(spark):
    """Eight of ten shingles shared is a link, and one less is not."""
    a = " ".join(f"a{k}" for k in range(13))  # 9 shingles
    b = " ".join(f"a{k}" for k in range(12)) + " z"  # 8 of them and another: 8 / 10
    c = " ".join(f"c{k}" for k in range(12))  # 8 shingles
    d = " ".join(f"c{k}" for k in range(11)) + " z"  # 7 of them and another: 7 / 9
    got = result(ngram_jaccard_join(spark.createDataFrame([(1, a), (2, b), (3, c), (4, d)], "doc_id long, text string")))
    assert got == {1: (9, 1), 2: (9, 1), 3: (8, 3), 4: (8, 4)}


def test_kernel_words_and_shingles():
    texts = pa.array(["Ab  c", None, "", "d e f g h i", "é x"])
    rows = []
    for lo, _, data, off in K.pieces(texts, 4):
        r, s = K.shingles(data, off)
        rows += [(lo + int(i), int(h)) for i, h in zip(r, s, strict=True)]
    assert sorted(i for i, _ in rows) == [0, 3, 3, 4] and len(set(rows)) == 4


def test_blocks_meet_every_pair_once():
    n = 37
    batch = pa.table({"s": [1] * n + [2] * 3, "i": [0] * n + [0] * 3, "j": [0] * n + [0] * 3, "chunk": [0] * (n + 3)}).to_batches(max_chunksize=7)
    got = set()
    for t in blocks.runs(batch, ["s", "i", "j"]):
        for i, j in blocks.pairs(t, ["s"]):
            got |= {(int(t["s"][a].as_py()), int(a), int(b)) for a, b in zip(i, j, strict=True)}
    assert len([g for g in got if g[0] == 1]) == n * (n - 1) // 2 and len([g for g in got if g[0] == 2]) == 3


def test_large_region_is_dealt_into_blocks(spark):
    df = spark.range(100).selectExpr("1L AS s", "id AS doc_id", "100L AS rows")
    got = blocks.deal(df, ["s"], "doc_id", "rows", 30).toPandas()
    met = set()
    for (_, i, j), g in got.groupby(["s", "i", "j"]):
        left, right = g[g.chunk == i].doc_id, g[g.chunk == j].doc_id
        met |= {(a, b) for a in left for b in right}
    assert all((a, b) in met or (b, a) in met for a in range(100) for b in range(a))
    assert np.bincount(got.doc_id).max() == 4


def test_sets_are_not_stored(spark, monkeypatch):
    """The shingle sets of candidates, the largest of its tables, are never written to the shared folder."""
    wide, write = [], ngram_join_module.Scratch.write

    def noted(self, df, name, by=None):
        wide.extend(name for _, kind in df.dtypes if kind.startswith("array"))
        return write(self, df, name, by)

    monkeypatch.setattr(ngram_join_module.Scratch, "write", noted)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, "nothing in common with the others at all")]
    got = {r.doc_id: r.component_id for r in ngram_join_module.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and not wide
