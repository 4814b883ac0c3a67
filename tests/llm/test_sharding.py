import random
import zlib

from pyspark.sql import functions as F

from lamina.llm import sharding
from lamina.llm.sharding import DIMENSIONS, kd_shards


def test_even_bytes_and_slots(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randint(0, 400), r.choice(["en", "de"]), "s0" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    rows += [(10_000 + i, "same text " * 20, "en", "s0") for i in range(1500)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "0 AS node", "1 AS key", "2 AS shard"), depth=4).toPandas()
    texts = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows) and all(got.text_crc32 == [zlib.crc32(texts[i].encode()) for i in got.doc_id]) and all(got["size"] == [len(texts[i]) + 1 for i in got.doc_id])
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 16 and by.max() - by.min() <= 0.03 * by.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def plain_tree(rows, depth):
    """Shard of each doc_id by a recursive k-d tree in memory; rows: (doc_id, size, place by dimension, tie)."""
    out = {}

    def split(part, node, level):
        if level == depth:
            out.update({r[0]: node for r in part})
            return
        spread = [max(r[2][d] for r in part) - min(r[2][d] for r in part) for d in range(len(DIMENSIONS))]
        d = spread.index(max(spread))
        part = sorted(part, key=lambda r: (r[2][d], r[3]))
        total, acc = sum(r[1] for r in part), 0
        for k, r in enumerate(part):
            if 2 * (acc + r[1]) >= total:
                break
            acc += r[1]
        k += total - 2 * acc > 2 * (acc + part[k][1]) - total
        split(part[:k], 2 * node, level + 1)
        split(part[k:], 2 * node + 1, level + 1)

    split(rows, 0, 0)
    return out


def test_equals_a_plain_tree(spark):
    """The same shards as a recursive tree over all rows, for 16 leaves."""
    r = random.Random(4)
    df = spark.createDataFrame([(i, "y" * r.randint(200, 400) + str(i), "en", f"s{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
    meta = [tuple(x) for x in sharding._metadata(df).select("doc_id", "size", *DIMENSIONS, F.xxhash64("doc_id").bitwiseAND(F.lit(sharding._HALF - 1))).collect()]
    low = [min(m[2 + d] for m in meta) for d in range(5)]
    wide = [max(1, max(m[2 + d] for m in meta) - low[d]) for d in range(5)]
    rows = [(m[0], m[1], [int((float(m[2 + d]) - low[d]) / wide[d] * (sharding._HALF - 1)) for d in range(5)], m[7]) for m in meta]
    got = {x.doc_id: x.shard for x in kd_shards(df, depth=4).collect()}
    assert got == plain_tree(rows, 4) and len(set(got.values())) == 16


def test_target_bytes(spark):
    got = kd_shards(spark.range(64).selectExpr("id AS doc_id", "repeat('y', 99) AS text"), target_bytes=1700)
    assert got.select("shard").distinct().count() == 4


def test_odd_rows(spark, docs_kind):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "é" * 50_000, "en", "s", 0), (2, "é" * 50_000, "en", "s", 0)]
    got = sorted((r.size, r.doc_id or 0) for r in kd_shards(spark.createDataFrame(rows, docs_kind), depth=4).collect())
    assert got == [(1, 0), (1, 1), (100_001, 2), (100_001, 2)]
    assert kd_shards(spark.createDataFrame([], docs_kind), depth=4).collect() == []
