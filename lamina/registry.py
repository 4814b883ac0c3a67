"""The mapping of query names to plans and to independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Start of every SQL text: the layout model over the raw tables.
BASE = """
mast AS (
  SELECT p_partkey AS m,
    CASE WHEN p_type = 'LARGE' AND p_size >= 49 THEN 1 WHEN p_type = 'SMALL' AND p_size <= 2 THEN 2 WHEN p_type = 'ECONOMY' THEN 3 ELSE 0 END AS klass,
    CAST(CASE WHEN p_type = 'LARGE' AND p_size >= 49 THEN p_size * 4000 WHEN p_type = 'SMALL' AND p_size = 1 THEN 800 WHEN p_type = 'SMALL' AND p_size = 2 THEN 25000 ELSE (2 + p_size % 19) * 200 END AS BIGINT) AS w,
    CAST(CASE WHEN p_type = 'LARGE' AND p_size >= 49 THEN p_size * 2000 WHEN p_type = 'SMALL' AND p_size = 1 THEN 25000 WHEN p_type = 'SMALL' AND p_size = 2 THEN 800 ELSE 1000 END AS BIGINT) AS h,
    CAST(CASE WHEN p_type = 'LARGE' AND p_size >= 49 THEN 30 WHEN p_type = 'SMALL' AND p_size <= 2 THEN 1 WHEN p_type = 'ECONOMY' THEN 3 ELSE 3 + p_size % 6 END AS BIGINT) AS rc
  FROM part
), lines AS (
  SELECT l_partkey AS m, CAST((l_orderkey + l_linenumber) % 8 AS INTEGER) AS o,
    datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 1000 + (l_linenumber % 5) * 200 AS x0,
    (CAST(round(l_extendedprice * 100) AS BIGINT) // 4200) * 1000 AS y0,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pno
  FROM lineitem
), plc AS (
  SELECT pno, l.m, o,
    CASE WHEN klass = 2 AND h > w THEN x0 // 50000 * 50000 ELSE x0 END AS x,
    CASE WHEN klass = 2 AND w > h THEN y0 // 50000 * 50000 ELSE y0 END AS y,
    klass, w, h, rc
  FROM lines AS l JOIN mast AS k ON l.m = k.m
), geo1 AS (
  SELECT count(*) AS n, CAST(greatest(0, ceil(log2(sqrt(count(*) / 256.0)))) AS BIGINT) AS maxz FROM lineitem
), geo AS (
  SELECT n, maxz, CAST(1 AS BIGINT) << maxz AS side, CAST(ceil(2512000.0 / (200 * (1 << maxz))) AS BIGINT) * 200 AS tile,
    CAST(ceil(2512000.0 / (200 * (1 << maxz))) AS BIGINT) * 200 * (CAST(1 AS BIGINT) << maxz) AS world
  FROM geo1
), tp AS (
  SELECT p.*, least(greatest(x // tile, 0), side - 1) AS tx, least(greatest(y // tile, 0), side - 1) AS ty, maxz, side, tile, world,
    CASE WHEN o IN (2, 3, 6, 7) THEN h ELSE w END AS bw, CASE WHEN o IN (2, 3, 6, 7) THEN w ELSE h END AS bh
  FROM plc AS p, geo
), lv AS (
  SELECT z, maxz, side >> (maxz - z) AS zside, tile << (maxz - z) AS ztile, maxz - z AS up FROM geo, (SELECT unnest(range(0, 16)) AS z) WHERE z <= maxz
), means AS (
  SELECT sum(w) / count(*) AS mean_w, sum(rc) / count(*) AS mean_rc FROM plc WHERE klass IN (0, 3)
)"""


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a plan; sql is a SELECT over BASE, after further CTEs if it starts with a comma."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{BASE.strip()}{'' if sql.lstrip().startswith(',') else ' '}{sql.strip()}"
        return f

    return add


def _load() -> None:
    from .plans import chip_queries, disk_queries, far_queries, geometry_queries, pyramid_queries, session_queries, source_queries, store_queries, validation_queries, view_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
