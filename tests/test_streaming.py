"""Keyed state over a stream gives what the replay gives."""

from pyspark.sql import functions as F

from lamina.streaming import sessions as S

STEPS = [(0, 0.0), (1, 1e-3), (2, 3e-3), (3, 9e-3)]


def events(spark):
    return spark.range(200).selectExpr("id % 4 AS user_id", "timestamp_seconds(1700000000 + id * 7) AS ts", "id AS event_id", "0.0005D * (1 + (id * 37) % 30) AS scale")


def test_level_stream_equals_replay(spark, tmp_path):
    src, out = str(tmp_path / "in"), "levels"
    events(spark).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events(spark).schema).parquet(src)
    q = S.level_stream(stream, STEPS).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.z for r in spark.table(out).collect()}
    want = {r.event_id: r.z for r in S.level_replay(events(spark), STEPS).collect()}
    assert got == want and len(set(want.values())) > 2


def test_debounce_stream_with_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events(spark).schema).parquet(src)
    q = S.latest_per_window(stream, "1 minute", "10 seconds").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.user_id, r.start): r.event_id for r in S.latest_per_window(events(spark), "1 minute").collect()}
    got = {(r.user_id, r.start): r.event_id for r in spark.table("late").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_lru_keeps_pins(spark):
    rows = [(1, i, t, 10, t == 0) for i, t in enumerate([0, 1, 2, 1, 3, 2, 0])]
    r = S.lru_replay(spark.createDataFrame(rows, "user_id long, ord int, tile long, bytes long, pinned boolean"), 30).first()
    assert (r.hits, r.loads, r.evicted, r.peak) == (2, 5, 2, 30)


def test_hysteresis_holds():
    z = S.next_level(None, 1.1e-3, STEPS)
    assert z == 1
    assert S.next_level(2, 3.0e-3, STEPS) == 2 and S.next_level(1, 3.1e-3, STEPS) == 1 and S.next_level(1, 4e-3, STEPS) == 2 and S.next_level(2, 2.9e-3, STEPS) == 1


def test_rolling_mean(spark):
    df = spark.range(10).selectExpr("1 AS user_id", "id AS ts", "id AS event_id", "cast(id as double) AS value")
    assert [r["mean"] for r in S.rolling_mean(df, 3).orderBy("ts").select(F.round("mean", 3).alias("mean")).collect()][:4] == [0.0, 0.5, 1.0, 2.0]
