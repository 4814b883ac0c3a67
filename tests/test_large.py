"""What only larger tables show: many masters, views of many tiles, what is shuffled."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import registry
from lamina.operators import encode, prefix, view
from lamina.operators import pyramid as P
from lamina.operators import synthetic as S
from lamina.sources import binary as B
from lamina.sources.tables import Design

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def one_tile(m):
    n = len(m)
    same = {c: np.full(n, 5, np.int64) for c in ("lx", "ly", "rc", "bw", "bh")}
    return encode.placement_tile("mid", 3, 1, 2, 1000, False, same | {"m": np.array(m, np.int64), "o": np.full(n, 7, np.int32)})


def test_tiles_name_more_masters_than_16_bits_can(spark, tmp_path):
    m = [0, 65_535, 65_536, 119_999, (1 << 24) - 1]
    folder = tmp_path / "tiles/3/1"
    folder.mkdir(parents=True)
    (folder / "2.bin").write_bytes(one_tile(m))
    rows = B.read_tile_placements(spark, f"file://{tmp_path}").collect()
    assert [(r.m, r.o) for r in sorted(rows, key=lambda r: r.ord)] == [(x, 7) for x in m]


def test_a_master_that_no_record_can_name_is_an_error():
    with pytest.raises(ValueError, match="master"):
        one_tile([1 << 24])


def shuffled(spark, run):
    """Records that the stages of a call have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None))}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("name", ["j05_view_cull", "f11_resident_only", "p27_origin_table", "o02_fetch_queue", "o04_first_instance", "o07_rails", "u02_wanted_set", "u03_prefetch_ring", "u04_pin_set", "u05_queue_actions", "j09_reconcile", "k13_disk_cache", "k14_tile_metrics"])
def test_tiles_of_views_are_not_shuffled(spark, name):
    """Views list 123,000 tiles here; placements are 60,000, views 10,000."""
    df = registry.queries()[name](spark, "/root/testdata/sf0.01")
    assert shuffled(spark, lambda: df.write.format("noop").mode("overwrite").save()) < 110_000


def rects_at_random(spark, n, side, keys):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, side, (2, n, 2))
    lo, hi = np.minimum(a, b), np.minimum(np.maximum(a, b), np.minimum(a, b) + 9)
    rows = [(int(k), *map(int, (*p, *q))) for k, p, q in zip(rng.integers(0, keys, n), lo, hi, strict=True)]
    return rows, spark.createDataFrame(rows, "k long, ax long, ay long, bx long, by long")


def tiles_of(r):
    return {(x, y) for x in range(r[1], r[3] + 1) for y in range(r[2], r[4] + 1)}


def test_rectangles_against_their_tiles(spark):
    side = 70
    there = {(x, y) for x in range(side) for y in range(side) if (x * 31 + y * 17) % 5 < 2}
    words = prefix.words(spark.createDataFrame(sorted(there), "tx long, ty long"))
    rows, rects = rects_at_random(spark, 60, side, 20)
    got = sorted(tuple(r) for r in prefix.existing_in(rects, words).select("k", "tx", "ty").collect())
    assert got == sorted((r[0], *t) for r in rows for t in tiles_of(r) & there)
    some = {r["k"] for r in prefix.not_empty(rects, words).collect()}
    assert some == {r[0] for r in rows if tiles_of(r) & there}
    assert sorted(tuple(r) for r in prefix.times_covered(rects, "k", side).select("k", "tx", "ty", "n").collect()) == sorted((*k, n) for k, n in Counter((r[0], *t) for r in rows for t in tiles_of(r)).items())
    most = {}
    for r in rows:
        most |= {t: max(most.get(t, 0), r[0]) for t in tiles_of(r)}
    assert {(r.tx, r.ty): r.k for r in prefix.most_over(rects, "k").collect()} == most
    own = {k: set().union(*(tiles_of(r) for r in rows if r[0] == k)) for k in {r[0] for r in rows}}
    for limit in (1, 8):
        first = sorted((r.k, r.ty, r.tx) for r in prefix.first_existing(rects, "k", words, side, limit).collect())
        assert first == sorted((k, *t) for k, ts in own.items() for t in sorted((y, x) for x, y in ts & there)[:limit])


def test_ring_around_rectangles_beside_and_beyond_the_grid(spark):
    side = 20
    rows = [(0, -3, 2, -1, 4), (0, 5, 5, 7, 7), (0, 7, 7, 12, 9), (1, 18, 18, 25, 21), (2, -9, -9, -2, -2), (3, 0, 0, 19, 19), (4, 20, 3, 22, 4)]
    rects = spark.createDataFrame(rows, "k long, ax long, ay long, bx long, by long")
    want = set()
    for k in range(5):
        seen = set().union(*(tiles_of(r) for r in rows if r[0] == k))
        near = set().union(*(tiles_of((k, r[1] - 1, r[2] - 1, r[3] + 1, r[4] + 1)) for r in rows if r[0] == k))
        want |= {(k, x, y) for x, y in near - seen if 0 <= x < side and 0 <= y < side}
    got = [tuple(r) for r in view.tiles_in(prefix.around(rects, "k", 1, side)).select("k", "tx", "ty").collect()]
    assert len(got) == len(want) and set(got) == want


def test_macros_in_small_batches_are_one_by_one(spark):
    """4,320 candidates, of which some 200,000 pairs conflict: no pairs are shuffled."""
    masters = spark.createDataFrame([(m, 1, 196_000 + m % 3 * 2000, 98_000 + m % 5 * 1000) for m in range(60)], "m long, klass int, w long, h long")
    rows = sorted(S.candidates(masters, 5).collect(), key=lambda r: (r.prio, r.id))
    taken = []
    for r in rows:
        if all(r.owner != t.owner and not (r.x0 < t.x1 + S.PADDING and t.x0 < r.x1 + S.PADDING and r.y0 < t.y1 + S.PADDING and t.y0 < r.y1 + S.PADDING) for t in taken):
            taken.append(r)
    assert 20 < len(taken) < 300
    for at_once in (7, 4096):
        assert sorted(r.id for r in S.macros(spark, masters, 5, at_once=at_once).collect()) == sorted(t.id for t in taken)
    assert shuffled(spark, lambda: S.macros(spark, masters, 5).collect()) < 20_000


@needs_tables
def test_hits_of_placements_of_all_sizes(spark):
    d = Design(spark, SF, per_tile=0.05)
    points = d.picks.where("qid < 150").withColumn("tag", F.expr("qid + 7"))
    p = P.tiled(d, True).collect()
    assert d.max_z >= 8
    want = {(q.qid, r.pno, q.tag, 4 * max(r.w, r.h) > d.tile) for q in points.collect() for r in p if r.x <= q.cx < r.x + r.bw and r.y <= q.cy < r.y + r.bh}
    got = view.hits(d, points, "tag").select("qid", "pno", "tag", "is_overflow")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    # Without broadcasts 55,203 records when oversized placements listed tiles of the deepest level.
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: view.hits(d, points).write.format("noop").mode("overwrite").save()) < 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


@needs_tables
def test_best_hit_shuffles_no_hits(spark):
    d = Design(spark, SF)
    p = d.placements(True).selectExpr("pno", "m", "o", "x", "y", "w AS bw", "h AS bh", "klass")
    found = spark.range(40).withColumnRenamed("id", "qid").crossJoin(F.broadcast(p.where("pno % 2 = 0"))).withColumn("is_overflow", F.expr("pno % 4 = 0"))
    rows = found.where("qid = 0").collect()
    best = min(rows, key=lambda r: (r.bw * r.bh, r.is_overflow, r.pno))
    got = view.best_hit(d, found).collect()
    assert {tuple(r)[1:] for r in got} == {(best.pno, best.m, best.klass, best.bw * best.bh, len(rows) - 1)} and len(got) == 40
    assert shuffled(spark, lambda: view.best_hit(d, found).collect()) < 40_000 < 40 * len(rows)


@needs_tables
def test_edges_of_hits_need_no_join_by_point(spark):
    plan = registry.queries()["f10_half_open"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join [qid" not in plan


@needs_tables
def test_pairs_of_macros_are_found_once(spark):
    df = registry.queries()["j12_macro_overlaps"](spark, SF)
    assert "HashAggregate(keys=[a" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == df.distinct().count()


@needs_tables
def test_tiles_of_all_levels_from_placements_dealt_once(spark):
    d = Design(spark, SF, per_tile=2)
    kinds = P.level_kinds(d).withColumn("kind", F.expr("CASE WHEN z < 2 THEN 'far' WHEN z < 5 THEN 'mid' ELSE 'deep' END")).localCheckpoint()
    by_file = encode.tile_files(d, kinds, P.placement_rows(d, kinds))
    want = {(r.path, bytes(r.content)) for r in by_file.collect()}
    got = encode.tile_files(d, kinds).collect()
    assert d.max_z > 5 and len(got) == len(want) and {(r.path, bytes(r.content)) for r in got} == want
    shuffle = lambda df: shuffled(spark, lambda: df.write.format("noop").mode("overwrite").save())
    assert shuffle(encode.tile_files(d, kinds)) < 0.9 * shuffle(by_file)
