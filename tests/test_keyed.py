"""Keyed streams, broken off and taken up again, give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from lamina.streaming import keyed as K


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, was)


def events(spark):
    """Bursts and pauses of three sessions, with equal times."""
    return spark.range(240).selectExpr("id % 3 AS user_id", "timestamp_millis(1700000000000 + id * 90 + (id * id) % 700 div 20 * 20) AS ts", "id AS event_id", "id div 40 % 3 AS level", "(id * 7) % 31 AS tile")


def streamed(spark, tmp_path, make):
    """Two runs from one checkpoint: the second takes up what the first left open; a late-comer in time moves the watermark on."""
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    e = events(spark)
    end = e.agg(F.max("event_id")).first()[0]
    last = e.where(f"event_id = {end}").selectExpr("99L AS user_id", "ts + interval 1 hour AS ts", "99999L AS event_id", "0L AS level", "0L AS tile")
    for part in (e.where("event_id < 130"), e.where("event_id >= 130"), last):
        # Events of a file come in any order.
        part.orderBy(F.hash("event_id")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(e.schema).parquet(src)
        q = make(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(out).where("user_id <> 99").collect())


def test_throttle_by_hand(spark):
    rows = [(1, 0, 1), (1, 100, 2), (1, 349, 3), (1, 350, 4), (1, 900, 5), (2, 10, 6), (2, 10, 7)]
    df = spark.createDataFrame(rows, "user_id long, ms long, event_id long").selectExpr("user_id", "timestamp_millis(ms) AS ts", "event_id")
    assert sorted(tuple(r) for r in K.throttle(df).collect()) == [(1, 0, 3, 3), (1, 350, 4, 1), (1, 900, 5, 1), (2, 10, 7, 2)]
    assert K.throttle(df.where("false")).collect() == []


def test_throttle_stream(spark, tmp_path, rocks):
    want = sorted(tuple(r) for r in K.throttle(events(spark)).collect())
    assert streamed(spark, tmp_path, lambda s: K.throttle_stream(s, "2 seconds")) == want
    assert len(want) > 40 and max(n for *_, n in want) > 1


def test_picks_stream(spark, tmp_path, rocks):
    want = sorted(tuple(r) for r in K.picks_again(events(spark)).collect())
    assert streamed(spark, tmp_path, lambda s: K.picks_stream(s, "2 seconds")) == want
    assert len(want) == 240 and {a for *_, a in want} == {True, False}
