"""Session queries: state machines replayed over events, and samples of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import count, nearest_rank
from ..registry import query
from ..sources.tables import Design
from ..streaming import keyed as K
from ..streaming import sessions as S

_STEPS = [(0, 0.0), (1, 1.93828e-4), (2, 5.02048e-4), (3, 1.17345e-3), (6, 6.53645e-3)]


def _scaled(d: Design):
    return d.table("events").selectExpr("user_id", "ts", "event_id", "cast(0.00002 * (1 + (event_id * 37) % 500) as double) AS scale")


_UP = "CASE WHEN s >= 0.00653645::DOUBLE * {h} THEN 6 WHEN s >= 0.00117345::DOUBLE * {h} THEN 3 WHEN s >= 0.000502048::DOUBLE * {h} THEN 2 WHEN s >= 0.000193828::DOUBLE * {h} THEN 1 ELSE 0 END"
_HOLD = "CASE WHEN r.z = 6 AND e.s >= 0.00653645::DOUBLE OR r.z = 3 AND e.s >= 0.00117345::DOUBLE OR r.z = 2 AND e.s >= 0.000502048::DOUBLE OR r.z = 1 AND e.s >= 0.000193828::DOUBLE THEN r.z ELSE 0 END"


@query(
    "t01_hysteresis",
    ", ev AS (SELECT user_id, event_id, CAST(0.00002 * (1 + (event_id * 37) % 500) AS DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events"
    f"), r AS (SELECT user_id, event_id, ord, {_UP.format(h='1.0')} AS z FROM ev WHERE ord = 1 UNION ALL SELECT e.user_id, e.event_id, e.ord, greatest({_UP.format(h='1.3').replace('s >=', 'e.s >=')}, {_HOLD}) FROM r JOIN ev AS e ON e.user_id = r.user_id AND e.ord = r.ord + 1"
    ") SELECT user_id, event_id, CAST(ord AS INTEGER) AS ord, z FROM r",
    recursive=True,
)
def t01(spark, sf_dir):
    """Levels that sessions show as their scale moves."""
    return S.level_replay(_scaled(Design(spark, sf_dir)), _STEPS).select("user_id", "event_id", "ord", "z")


@query("t02_lru_cache")
def t02(spark, sf_dir):
    """Hits and evictions of each session's tile cache."""
    e = Design(spark, sf_dir).table("events")
    a = e.withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).selectExpr("user_id", "ord", "event_id % 40 AS tile", "1000 + (event_id % 40) * 50 AS bytes", "event_id % 40 < 3 AS pinned")
    return S.lru_replay(a, 16_000)


@query("t07_debounce", "SELECT user_id, epoch_ms(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01')) AS start_ms, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL")
def t07(spark, sf_dir):
    """Last event of each session and hour."""
    e = Design(spark, sf_dir).table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.latest_per_window(e, "1 hour").select("user_id", F.unix_millis(F.col("start").cast("timestamp")).alias("start_ms"), "event_id", "n")


_HOUR = 3_600_000


@query(
    "t07b_throttle",
    ", ev AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events"
    f"), r AS (SELECT user_id, event_id, ord, ms AS start_ms FROM ev WHERE ord = 1 UNION ALL SELECT e.user_id, e.event_id, e.ord, CASE WHEN e.ms >= r.start_ms + {_HOUR} THEN e.ms ELSE r.start_ms END FROM r JOIN ev AS e ON e.user_id = r.user_id AND e.ord = r.ord + 1"
    ") SELECT user_id, start_ms, arg_max(event_id, ord) AS event_id, count(*) AS n FROM r GROUP BY user_id, start_ms",
    recursive=True,
)
def t07b(spark, sf_dir):
    """What a trailing throttle of an hour lets through: timers start with a session's events, not on the hour."""
    e = Design(spark, sf_dir).table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.throttle(e, _HOUR)


@query("t09_reorigin", ", e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, (event_id * 7919) % 2500000 AS cx FROM events) SELECT user_id, event_id, abs(cx - first_value(cx) OVER (PARTITION BY user_id ORDER BY ord)) * 0.5::DOUBLE > 1000000 AS far FROM e")
def t09(spark, sf_dir):
    """Events whose drift from the session's origin exceeds the precision limit."""
    e = Design(spark, sf_dir).table("events").selectExpr("user_id", "ts", "event_id", "(event_id * 7919) % 2500000 AS cx")
    o = F.first("cx").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", (F.abs(F.col("cx") - o) * F.lit(0.5) > 1000000).alias("far"))


@query("t10_pick_again", ", e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id % 4 AS level, event_id % 3 AS residency FROM events) SELECT user_id, event_id, coalesce(level <> lag(level) OVER w OR residency <> lag(residency) OVER w, true) AS again FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ord)")
def t10(spark, sf_dir):
    """Whether a pick has to be answered again: level or residency changed."""
    e = Design(spark, sf_dir).table("events").selectExpr("user_id", "ts", "event_id", "event_id % 4 AS level", "event_id % 3 AS residency")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = (F.col("level") != F.lag("level").over(w)) | (F.col("residency") != F.lag("residency").over(w))
    return e.select("user_id", "event_id", F.coalesce(changed, F.lit(True)).alias("again"))


@query("t10b_arrivals", ", e AS (SELECT user_id, event_id, ts, event_id // 3 % 4 AS level, event_id * 7 % 64 AS tile FROM events) SELECT user_id, event_id, level IS DISTINCT FROM lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) OR row_number() OVER (PARTITION BY user_id, tile ORDER BY ts, event_id) = 1 AS again FROM e")
def t10b(spark, sf_dir):
    """Whether a pick has to be answered again as tiles arrive: another level, or a tile that wasn't there."""
    return K.picks_again(Design(spark, sf_dir).table("events").selectExpr("user_id", "ts", "event_id", "event_id div 3 % 4 AS level", "event_id * 7 % 64 AS tile"))


@query("t04_residency_counters", ", e AS (SELECT event_id % 10 AS step, event_id % 64 AS tile FROM events), s AS (SELECT DISTINCT step, tile FROM e), j AS (SELECT a.step AS step, count(*) AS resident, count(*) FILTER (WHERE b.tile IS NULL) AS added FROM s a LEFT JOIN s b ON b.step = a.step - 1 AND b.tile = a.tile GROUP BY a.step) SELECT step, resident, added FROM j")
def t04(spark, sf_dir):
    """Resident and newly added tiles at each step."""
    s = Design(spark, sf_dir).table("events").selectExpr("event_id % 10 AS step", "event_id % 64 AS tile").distinct()
    b = s.select((F.col("step") + 1).alias("step"), "tile", F.lit(True).alias("was"))
    return s.join(b, ["step", "tile"], "left").groupBy("step").agg(count().alias("resident"), F.count_if(F.col("was").isNull()).alias("added"))


@query("w08_rolling_mean", "SELECT event_id, count(value) OVER w AS samples, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / (100 * count(value) OVER w) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def w08(spark, sf_dir):
    """Mean of the last sixty samples of each session, in whole hundredths."""
    e = Design(spark, sf_dir).table("events").withColumn("cents", F.expr("cast(round(value * 100) as bigint)"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-59, 0)
    return e.select("event_id", F.count("value").over(w).alias("samples"), (F.sum("cents").over(w).cast("double") / (100 * F.count("value").over(w))).alias("mean"))


@query("w09_median_sample", ", l AS (SELECT event_type, list_sort(list(value)) AS l, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, l[1 + least(n - 1, n * 50 // 100)] AS median FROM l")
def w09(spark, sf_dir):
    return nearest_rank(Design(spark, sf_dir).table("events"), ["event_type"], "value", 50, "median")


@query("a23_latency_percentiles", ", l AS (SELECT event_type, list_sort(list(value)) AS l, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, n, l[1 + least(n - 1, n * 50 // 100)] AS p50, l[1 + least(n - 1, n * 90 // 100)] AS p90, l[1 + least(n - 1, n * 99 // 100)] AS p99, l[n] AS hi FROM l")
def a23(spark, sf_dir):
    """Percentiles of samples by kind."""
    e = Design(spark, sf_dir).table("events")
    out = e.groupBy("event_type").agg(count().alias("n"), F.max("value").alias("hi"))
    for q, name in ((50, "p50"), (90, "p90"), (99, "p99")):
        out = out.join(nearest_rank(e, ["event_type"], "value", q, name), "event_type")
    return out


@query("w10_eviction", ", c AS (SELECT user_id, event_id, 1000 + (event_id % 40) * 50 AS bytes, event_id % 40 < 3 AS pinned, ts FROM events), r AS (SELECT *, sum(CASE WHEN pinned THEN 0 ELSE bytes END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newer, sum(CASE WHEN pinned THEN bytes ELSE 0 END) OVER (PARTITION BY user_id) AS pins FROM c) SELECT user_id, event_id FROM r WHERE NOT pinned AND newer + pins > 16000")
def w10(spark, sf_dir):
    """Entries that go when the oldest are evicted to a byte budget; pinned ones stay."""
    c = Design(spark, sf_dir).table("events").selectExpr("user_id", "event_id", "ts", "1000 + (event_id % 40) * 50 AS bytes", "event_id % 40 < 3 AS pinned")
    newer = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    r = c.withColumns({"newer": F.sum(F.expr("CASE WHEN pinned THEN 0 ELSE bytes END")).over(newer), "pins": F.sum(F.expr("CASE WHEN pinned THEN bytes ELSE 0 END")).over(Window.partitionBy("user_id"))})
    return r.where("not pinned and newer + pins > 16000").select("user_id", "event_id")


@query("w11_every_nth", ", r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE i % greatest(1, n // 10) = 0")
def w11(spark, sf_dir):
    """Every so many-th event of a session, about ten of them."""
    w = Window.partitionBy("user_id")
    r = Design(spark, sf_dir).table("events").withColumns({"i": F.row_number().over(w.orderBy("ts", "event_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    return r.where("i % greatest(1, n div 10) = 0").select("user_id", "event_id")


@query("o08_recency_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events")
def o08(spark, sf_dir):
    return Design(spark, sf_dir).table("events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long").alias("age"))


@query("j19_needed_files", ", need AS (SELECT DISTINCT event_id % 97 AS f FROM events), have AS (SELECT DISTINCT p_size AS f FROM part) SELECT f, f IN (SELECT f FROM have) AS have FROM need")
def j19(spark, sf_dir):
    """Files a job needs: which are there and which are missing."""
    d = Design(spark, sf_dir)
    need = d.table("events").selectExpr("event_id % 97 AS f").distinct()
    have = d.table("part").select(F.col("p_size").cast("long").alias("f")).distinct()
    return need.join(have, "f", "left_semi").withColumn("have", F.lit(True)).unionByName(need.join(have, "f", "left_anti").withColumn("have", F.lit(False)))


@query(
    "b03_scripted_pan",
    ", sp AS (SELECT unnest(range(0, 40)) AS q), ra AS (SELECT q, q * 50000 // tile AS ax, least((q * 50000 + 500000) // tile, side - 1) AS bx, q * 30000 // tile AS ay, least((q * 30000 + 300000) // tile, side - 1) AS byy FROM sp, geo), oc AS (SELECT DISTINCT tx, ty FROM tp), w AS (SELECT q AS step, tx, ty FROM ra JOIN oc ON tx BETWEEN ax AND bx AND ty BETWEEN ay AND byy), p AS (SELECT step + 1 AS step, tx, ty FROM w), j AS (SELECT coalesce(w.step, p.step) AS step, p.tx IS NULL AS added, w.tx IS NULL AS removed FROM w FULL JOIN p ON w.step = p.step AND w.tx = p.tx AND w.ty = p.ty) SELECT step, count(*) FILTER (WHERE added) AS added, count(*) FILTER (WHERE removed) AS removed FROM j WHERE step < 40 GROUP BY step",
)
def b03(spark, sf_dir):
    """A scripted pan: views along a line, and the tiles each step adds and drops."""
    from ..operators import pyramid as P
    from ..operators import view as V

    d = Design(spark, sf_dir)
    steps = spark.range(40).selectExpr("id AS qid", "id * 50000 AS x0", "id * 30000 AS y0", "id * 50000 + 500000 AS x1", "id * 30000 + 300000 AS y1")
    t = V.tiles_in(V.tile_range(steps, d.tile, d.side, 0)).join(P.tile_counts(d), ["tx", "ty"]).selectExpr("qid AS step", "tx", "ty")
    change = V.reconcile(t, t.withColumn("step", F.col("step") + 1), ["step", "tx", "ty"])
    return change.where("step < 40").groupBy("step").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
