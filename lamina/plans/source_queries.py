"""Ingest queries: library and design text written from the tables, parsed, and reported."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.stats import count, weighted_rank
from ..registry import query
from ..sources import lef
from ..sources.tables import Design
from .pyramid_queries import _COUNTS, _RECTS

_CLASS = {0: "CORE", 1: "BLOCK", 2: "COVER", 3: "ENDCAP"}
_LAYER_NAMES = ["POLY", "METAL1", "VIA1", "METAL2", "VIA2", "METAL3", "VIA3", "METAL4", "METAL5", "VIA5", "METAL6", "LOCALI"]


def _library(d: Design):
    """MACRO records of the masters, in microns of 1000 units, with reversed corners here and there."""
    name = F.element_at(F.array(*map(F.lit, _LAYER_NAMES)), F.col("layer") + 1)
    um = lambda c: F.format_string("%.3f", F.col(c) / 1000.0)
    box = F.when(F.col("r") % 2 == 0, F.concat_ws(" ", um("x"), um("y"), um("x1"), um("y1"))).otherwise(F.concat_ws(" ", um("x1"), um("y1"), um("x"), um("y")))
    part = F.when(F.col("flags") == 1, "  PIN P\n").otherwise("  OBS\n")
    shape = F.concat(part, F.lit("    LAYER "), name, F.lit(" ;\n      RECT "), box, F.lit(" ;\n"))
    body = d.rects.withColumns({"x1": F.expr("x + w"), "y1": F.expr("y + h")}).groupBy("m").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", shape.alias("s")))), lambda s: s["s"]), "").alias("body"))
    head = F.concat(F.lit("M"), F.col("m"), F.lit("\n  CLASS "), F.element_at(F.create_map(*(F.lit(x) for kv in _CLASS.items() for x in kv)), F.col("klass")), F.lit(" ;\n  ORIGIN 0 0 ;\n  SIZE "), um("w"), F.lit(" BY "), um("h"), F.lit(" ;\n"))
    return d.masters.join(body, "m").select(F.concat(head, "body", F.lit("END M"), "m").alias("value"))


def _statements(d: Design):
    o = F.element_at(F.array(*map(F.lit, G.ORIENTATIONS)), F.col("o") + 1)
    status = F.when(F.col("klass") == 1, "FIXED").when(F.col("klass") == 2, "COVER").otherwise("PLACED")
    placed = F.concat(F.lit(" + "), status, F.lit(" ( "), F.col("x"), F.lit(" "), F.col("y"), F.lit(" ) "), o)
    text = F.concat(F.lit("\n- u"), F.col("pno"), F.lit(" M"), F.col("m"), F.when(F.col("pno") % 50 == 0, F.lit(" + UNPLACED")).otherwise(placed), F.lit(" "))
    rows = d.placements(True).select(text.alias("value"), F.lit("d").alias("file"), "pno")
    ends = d.spark.createDataFrame([("\nCOMPONENTS 1 ", "d", -1), ("\nEND COMPONENTS\n", "d", 1 << 62)], "value string, file string, pno long")
    return rows.unionByName(ends).withColumnRenamed("pno", "at")


@query("s01_tech_lef", "SELECT CAST(i AS INTEGER) AS ord, ['POLY', 'METAL1', 'VIA1', 'METAL2', 'VIA2', 'METAL3', 'VIA3', 'METAL4', 'METAL5', 'VIA5', 'METAL6', 'LOCALI'][i + 1] AS name, CASE WHEN i IN (2, 4, 6, 9) THEN 'CUT' ELSE 'ROUTING' END AS type, CAST(1000 AS DOUBLE) AS dbu FROM (SELECT unnest(range(0, 12)) AS i)")
def s01(spark, sf_dir):
    """Layers of a technology file, in order."""
    text = "UNITS\n  DATABASE MICRONS 1000 ;\nEND UNITS\n" + "".join(f"LAYER {n}\n  TYPE {'CUT' if n.startswith('VIA') else 'ROUTING'} ;\n  PITCH 0.2 ;\nEND {n}\n" for n in _LAYER_NAMES)
    layers, dbu = lef.tech_layers(spark.createDataFrame([(text,)], "value string"))
    return layers.crossJoin(F.broadcast(dbu))


@query("s02_cell_lef", "SELECT 'M' || m AS name, CASE WHEN klass = 1 THEN 1 ELSE 0 END AS klass, w, h FROM mast")
def s02(spark, sf_dir):
    """Masters of a cell library."""
    return lef.masters_of(_library(Design(spark, sf_dir)), 1000).select("name", "klass", "w", "h")


@query("p12_lef_rects", _RECTS + "SELECT 'M' || m AS name, x, y, w, h, flags, CASE WHEN layer = 1 THEN 5 WHEN layer = 3 THEN 7 WHEN layer IN (2, 4, 6, 9) THEN 6 ELSE 8 END AS layer FROM rect")
def p12(spark, sf_dir):
    """Rects of a cell library: rounded, corners in order, clamped, layers folded (P11)."""
    return lef.rects_of(lef.masters_of(_library(Design(spark, sf_dir)), 1000), 1000).where("fate = 'kept'").select("name", "x", "y", "w", "h", "flags", "layer")


@query("p11_layer_folding", _RECTS + "SELECT CASE WHEN layer IN (1, 2, 3, 5) THEN 'known' WHEN layer IN (0, 11) THEN 'unknown' ELSE 'folded' END AS fold, count(*) AS rects FROM rect GROUP BY 1")
def p11(spark, sf_dir):
    """Rects whose layer is known, folded or unknown."""
    return lef.rects_of(lef.masters_of(_library(Design(spark, sf_dir)), 1000), 1000).groupBy("fold").agg(count().alias("rects"))


@query("p13_outline_rect", "SELECT 'M' || m AS name, rc + 1 AS rects FROM mast")
def p13(spark, sf_dir):
    """Rects of each master with its outline first."""
    return lef.rects_of(lef.masters_of(_library(Design(spark, sf_dir)), 1000), 1000, True).groupBy("name").agg(count().alias("rects"))


@query("f12_clipped_rects", "SELECT (SELECT count(*) FROM part) AS polygons, (SELECT count(*) FROM part) AS clipped")
def f12(spark, sf_dir):
    """Polygons that are skipped and rects that clipping empties: each master gets one of both."""
    more = F.concat(F.lit("  OBS\n    LAYER METAL1 ;\n      POLYGON 0 0 1 1 2 0 ;\n      RECT -9 -9 -8 -8 ;\nEND "))
    lib = _library(Design(spark, sf_dir)).select(F.regexp_replace("value", "END M", "").alias("value")).select(F.concat("value", F.lit("\n"), more).alias("value"))
    r = lef.rects_of(lef.masters_of(lib, 1000), 1000)
    return r.agg(F.count_if(F.col("fate") == "polygon").alias("polygons"), F.count_if(F.col("fate") == "clipped").alias("clipped"))


@query("s03_def_components", "SELECT 'u' || pno AS name, 'M' || m AS master, CASE WHEN pno % 50 = 0 THEN 'UNPLACED' WHEN klass = 1 THEN 'FIXED' WHEN klass = 2 THEN 'COVER' ELSE 'PLACED' END AS status, CASE WHEN pno % 50 <> 0 THEN x END AS x, CASE WHEN pno % 50 <> 0 THEN y END AS y, CASE WHEN pno % 50 <> 0 THEN ['N', 'S', 'W', 'E', 'FN', 'FS', 'FW', 'FE'][o + 1] END AS orient FROM plc")
def s03(spark, sf_dir):
    """Components of a design file."""
    return lef.components(_statements(Design(spark, sf_dir)))


@query("f14_placed_split", "SELECT CASE WHEN pno % 50 = 0 THEN 'UNPLACED' WHEN klass = 1 THEN 'FIXED' WHEN klass = 2 THEN 'COVER' ELSE 'PLACED' END AS status, count(*) AS n FROM plc GROUP BY 1")
def f14(spark, sf_dir):
    """Components by status."""
    return lef.components(_statements(Design(spark, sf_dir))).groupBy("status").agg(count().alias("n"))


@query("j02_component_masters", "SELECT CASE WHEN klass = 1 THEN 1 ELSE 0 END AS klass, count(*) AS n FROM plc WHERE m % 10 <> 3 GROUP BY 1")
def j02(spark, sf_dir):
    """Components joined to a library that lacks every tenth master, by name."""
    d = Design(spark, sf_dir)
    lib = lef.masters_of(_library(d), 1000).where("cast(substr(name, 2) as bigint) % 10 <> 3")
    return lef.components(_statements(d)).join(lib.select(F.col("name").alias("master"), "klass"), "master").groupBy("klass").agg(count().alias("n"))


@query("f13_missing_masters", "SELECT 'M' || m AS master, count(*) AS components FROM plc WHERE m % 10 = 3 GROUP BY m")
def f13(spark, sf_dir):
    """Masters that components name and the library lacks."""
    d = Design(spark, sf_dir)
    lib = lef.masters_of(_library(d), 1000).where("cast(substr(name, 2) as bigint) % 10 <> 3")
    return lef.components(_statements(d)).join(lib.select(F.col("name").alias("master")), "master", "left_anti").groupBy("master").agg(count().alias("components"))


@query("k16_name_report", ", l AS (SELECT length('u' || pno) AS len, count(*) AS n FROM plc GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY len) AS acc, sum(n) OVER () AS total FROM l) SELECT CAST(sum(n) AS BIGINT) AS names, CAST(sum(n * len) AS BIGINT) AS bytes, CAST(min(len) AS INTEGER) AS lo, CAST(min(len) FILTER (WHERE acc >= 0.5 * total) AS INTEGER) AS p50, CAST(min(len) FILTER (WHERE acc >= 0.95 * total) AS INTEGER) AS p95, CAST(max(len) AS INTEGER) AS hi FROM c")
def k16(spark, sf_dir):
    """Lengths of instance names."""
    n = lef.components(_statements(Design(spark, sf_dir))).groupBy(F.octet_length("name").alias("len")).agg(count().alias("n")).withColumn("one", F.lit(1))
    out = n.groupBy("one").agg(F.sum("n").alias("names"), F.sum(F.expr("n * len")).alias("bytes"), F.min("len").alias("lo"), F.max("len").alias("hi"))
    for q, name in ((0.5, "p50"), (0.95, "p95")):
        out = out.join(weighted_rank(n, ["one"], "len", "n", q, name), "one")
    return out.drop("one")


@query("s03b_def_header", "SELECT CAST(2000 AS DOUBLE) AS dbu, CAST(0 AS BIGINT) AS x0, CAST(0 AS BIGINT) AS y0, world AS x1, world AS y1 FROM geo")
def s03b(spark, sf_dir):
    """Units and die of a design file."""
    d = Design(spark, sf_dir)
    s = spark.createDataFrame([("VERSION 5.8 ",), ("\nUNITS DISTANCE MICRONS 2000 ",), (f"\nDIEAREA ( 0 0 ) ( {d.world} {d.world} ) ",)], "value string")
    return lef.design_units(s)


@query("s03c_def_rows", ", r AS (SELECT unnest(range(0, 100)) AS i) SELECT 'ROW_' || i AS name, 'core' AS site, CAST(0 AS BIGINT) AS x, i * 1000 AS y, CASE WHEN i % 2 = 0 THEN 'N' ELSE 'FS' END AS orient, CAST(12560 AS BIGINT) AS nx, CAST(1 AS BIGINT) AS ny, CAST(200 AS BIGINT) AS step, CAST(0 AS BIGINT) AS step_y FROM r")
def s03c(spark, sf_dir):
    """Rows of a design file."""
    s = spark.range(100).selectExpr("concat('\\nROW ROW_', id, ' core 0 ', id * 1000, CASE WHEN id % 2 = 0 THEN ' N' ELSE ' FS' END, ' DO 12560 BY 1 STEP 200 0 ') AS value")
    return lef.rows_of(s)


_TECH = """VERSION 5.8 ;
UNITS
  DATABASE MICRONS 2000.5 ;
END UNITS
PROPERTYDEFINITIONS
  LAYER LEF58_TYPE STRING ;
END PROPERTYDEFINITIONS
LAYER NWELL
  TYPE MASTERSLICE ;
END NWELL
LAYER OVERLAP
  TYPE OVERLAP ;
END OVERLAP
LAYER METAL1
  TYPE ROUTING ;
END METAL1
LAYER DIFF
END DIFF
VIA V1
  LAYER METAL1 ;
END V1
"""


@query("s01b_tech_lef_stack", "SELECT * FROM (VALUES (0, 'NWELL', 'MASTERSLICE', 2000.5::DOUBLE), (1, 'OVERLAP', 'OVERLAP', 2000.5), (2, 'METAL1', 'ROUTING', 2000.5), (3, 'DIFF', '', 2000.5)) AS t(ord, name, type, dbu)")
def s01b(spark, sf_dir):
    """Every declared layer, whatever its type, and a decimal unit; references are none."""
    layers, dbu = lef.tech_layers(spark.createDataFrame([(_TECH,)], "value string"))
    return layers.crossJoin(F.broadcast(dbu))


_CELLS = """MACRO A
  CLASS BLOCK ;
  ORIGIN 1 0.5 ;
  SIZE 1e1 BY 4 ;
  PIN p
    PORT
      LAYER METAL1 ;
        RECT 3 2 2 1 ;
        RECT 1.05E1 3 20 9 ;
        RECT 50 50 60 60 ;
        POLYGON 0 0 1 1 2 2 ;
    END
  END p
  OBS
    LAYER METAL5 ;
      RECT 2 1 3 2 ;
    LAYER WEIRD ;
      RECT 1 0.5 2.0005 1.5 ;
  END
END A
MACRO B
  CLASS CORE ;
  SIZE 2 BY 2 ;
END B
"""


def _cells(spark):
    records = spark.createDataFrame([(x,) for x in _CELLS.split("MACRO ")], "value string")
    m = lef.masters_of(records, 1000)
    return m, lef.rects_of(m, 1000)


@query("p12b_lef_origin", "SELECT * FROM (VALUES ('A', 0, 5, 1, 1000, 500, 1000, 1000, false), ('A', 1, 5, 1, 9500, 2500, 500, 1500, true), ('A', 2, 8, 0, 1000, 500, 1000, 1000, false), ('A', 3, 8, 0, 0, 0, 1001, 1000, false)) AS t(name, r, layer, flags, x, y, w, h, clamped)")
def p12b(spark, sf_dir):
    """Rects of a master with an origin, numbers with exponents, and parts in and out of a pin."""
    return _cells(spark)[1].where("fate = 'kept'").select("name", "r", "layer", "flags", *(F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")), "clamped")


@query("s02b_lef_statistics", "SELECT what, key, CAST(n AS BIGINT) AS n FROM (VALUES ('class', 'BLOCK', 1), ('class', 'CORE', 1), ('origin', 'not zero', 1), ('pins', 'all', 1), ('lines', 'all', 26), ('rects', 'pin', 2), ('rects', 'obs', 2), ('rects', 'clipped', 1), ('rects', 'polygon', 1), ('fold', 'known', 2), ('fold', 'folded', 1), ('fold', 'unknown', 1), ('clamped', 'all', 2)) AS t(what, key, n)")
def s02b(spark, sf_dir):
    """What a library held and what became of it."""
    return lef.statistics(*_cells(spark))


_DESIGN = """VERSION 5.8 ;
UNITS DISTANCE MICRONS 2000 ;
DIEAREA ( -10 0 ) ( 90 80 ) ;
ROW R0 core 0 0 N DO 10 BY 1 STEP 200 0 ;
ROW R1 core 0 1000 FS DO 1 BY 7 STEP 0 1000 ;
REGIONS 1 ;
- r1 ( 0 0 ) ( 5 5 ) ;
END REGIONS
COMPONENTS 5 ;
- u1 INVX1 + PLACED ( 4 -5 ) FN ;
- u2 INVX1 ;
- u3 BUF
  + SOURCE DIST
  + FIXED ( 6 7 ) S ;
- u4 BUF + UNPLACED ;
- u5 RAM + COVER ( 1 2 ) W + HALO 1 1 1 1 ;
END COMPONENTS
PINS 1 ;
- p1 + NET n1 + PLACED ( 0 0 ) N ;
END PINS
BLOCKAGES 1 ;
- LAYER M1 + SLOTS RECT ( 0 0 ) ( 1 1 ) ;
END BLOCKAGES
GROUPS 1 ;
- g1 u* + REGION r1 ;
END GROUPS
END DESIGN
"""


def _design(spark):
    return lef.statements_of(spark.createDataFrame([("a.def", _DESIGN)], "file string, value string"))


@query("s03d_def_sections", "SELECT name, master, status, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, orient FROM (VALUES ('u1', 'INVX1', 'PLACED', 4, -5, 'FN'), ('u2', 'INVX1', 'UNPLACED', NULL, NULL, NULL), ('u3', 'BUF', 'FIXED', 6, 7, 'S'), ('u4', 'BUF', 'UNPLACED', NULL, NULL, NULL), ('u5', 'RAM', 'COVER', 1, 2, 'W')) AS t(name, master, status, x, y, orient)")
def s03d(spark, sf_dir):
    """Components of a design with regions, pins, blockages and groups, which are none."""
    return lef.components(_design(spark))


@query("s03e_def_rows_2d", "SELECT name, site, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, orient, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, CAST(step AS BIGINT) AS step, CAST(step_y AS BIGINT) AS step_y FROM (VALUES ('R0', 'core', 0, 0, 'N', 10, 1, 200, 0), ('R1', 'core', 0, 1000, 'FS', 1, 7, 0, 1000)) AS t(name, site, x, y, orient, nx, ny, step, step_y)")
def s03e(spark, sf_dir):
    """Rows with a site, a count and a step in both directions."""
    return lef.rows_of(_design(spark))


@query("d1_unit_scaling", "SELECT m, 2 * w AS w, 2 * h AS h FROM mast")
def d1(spark, sf_dir):
    """Library lengths of 1000 units per micron in a design of 2000."""
    m = Design(spark, sf_dir).masters
    return m.select("m", lef.to_units(F.col("w"), 1000, 2000).alias("w"), lef.to_units(F.col("h"), 1000, 2000).alias("h"))


@query("s04c_library_synthesis", ", k AS (SELECT unnest(range(0, 500)) AS m), c AS (SELECT m, (2 + m % 19) * 200 AS w, 3 + m % 6 AS rc FROM k) SELECT m, unnest(range(0, rc)) AS r, w // (rc + 1) AS rect_w FROM c")
def s04c(spark, sf_dir):
    """Rects of synthetic standard cells."""
    c = spark.range(500).selectExpr("id AS m", "(2 + id % 19) * 200 AS w", "3 + id % 6 AS rc")
    return c.withColumn("r", F.explode(F.expr("sequence(0L, rc - 1)"))).selectExpr("m", "r", "w div (rc + 1) AS rect_w")


@query("s04e_power_grid", ", i AS (SELECT unnest(range(0, 51)) AS i) SELECT 'v' AS axis, i * 50000 AS position, CASE WHEN i % 4 = 0 THEN 1600 ELSE 800 END AS thickness FROM i UNION ALL SELECT 'h', i * 50000, CASE WHEN i % 2 = 0 THEN 1600 ELSE 800 END FROM i")
def s04e(spark, sf_dir):
    """Straps of a power grid in both directions, every fourth and every second one wider."""
    i = spark.range(51)
    one = lambda axis, n: i.selectExpr(f"'{axis}' AS axis", "id * 50000 AS position", f"CASE WHEN id % {n} = 0 THEN 1600 ELSE 800 END AS thickness")
    return one("v", 4).unionByName(one("h", 2))


@query("s04b_density_field")
def s04b(spark, sf_dir):
    """The synthetic density field on a 64 by 64 grid, and its mean (A25)."""
    import numpy as np

    from ..operators.place import density

    def run(batches):
        for f in batches:
            u, v = (f["id"] % 64 + 0.5) / 64, (f["id"] // 64 + 0.5) / 64
            f["d"] = density(np.asarray(u), np.asarray(v), 42)
            yield f[["id", "d"]]

    return spark.range(4096).mapInPandas(run, "id long, d double")


@query("k11_manifest_levels", _COUNTS + """SELECT CAST(z AS INTEGER) AS z, '{"z":' || z || ',"kind":"' || kind || '","tiles":' || tiles || ',"p95":' || p95 || '}' AS doc FROM kinds""")
def k11(spark, sf_dir):
    """The manifest's entry of each level, as JSON."""
    from ..operators import pyramid as P

    return P.level_kinds(Design(spark, sf_dir)).select("z", F.to_json(F.struct("z", "kind", "tiles", "p95")).alias("doc"))


@query("s08b_manifest_read", _COUNTS + "SELECT CAST(z AS INTEGER) AS z, kind, tiles, p95 FROM kinds")
def s08b(spark, sf_dir):
    """The manifest's levels, read back from JSON with a fixed schema."""
    doc = F.from_json("doc", "z int, kind string, tiles long, p95 long", {"mode": "FAILFAST"})
    return k11(spark, sf_dir).select(doc.alias("d")).select("d.*")


@query("o06_catalog_order", "SELECT p_type AS name, count(*) AS designs, CAST(sum(p_size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY p_type) AS place FROM part GROUP BY p_type")
def o06(spark, sf_dir):
    """A catalog by name, with its sizes (S9)."""
    from pyspark.sql import Window

    c = Design(spark, sf_dir).table("part").groupBy(F.col("p_type").alias("name")).agg(count().alias("designs"), F.sum("p_size").alias("bytes"))
    return c.withColumn("place", F.row_number().over(Window.orderBy("name")).cast("long"))
