"""LEF and DEF text as DataFrames, parsed by DataFrame operations alone.

Files are read by their own separators: a technology file whole, a cell library
by `MACRO`, a design by `;`, so each record is one statement and large files split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import js_round

# Class and layer codes of the layout model. All other classes are standard cells.
CLASSES = {"BLOCK": 1}
LAYERS = {"METAL1": 5, "VIA1": 6, "METAL2": 7, "METAL3": 8}
# Layers without a code of their own: metals fold into the third, vias into the first, and are counted.
FOLDED = {**{f"METAL{k}": 8 for k in range(4, 10)}, **{f"VIA{k}": 6 for k in range(2, 9)}}
#: Any other layer is drawn as this one and counted as unknown. Names are matched without regard to case.
UNKNOWN = 8
NUMBER = r"([0-9.eE+-]+)"


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_macros(spark: SparkSession, path: str) -> DataFrame:
    """One record per master; the first holds what comes before any."""
    return spark.read.option("lineSep", "\nMACRO ").text(path)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """value of each statement, and its place: file and at, which orders a file's statements."""
    rows = spark.read.option("lineSep", ";").text(path)
    # A partition may hold several pieces of files, each in order.
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))


def statements_of(text: DataFrame) -> DataFrame:
    """The same of whole files (file, value)."""
    return text.select("file", F.posexplode(F.split("value", ";")).alias("at", "value"))


def _code(name: Column, table: dict[str, int], default: int | None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(m, name), F.lit(default))


def tech_layers(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers (ord, name, type) in file order, type empty where none is stated, and the database units per micron.

    Only LAYER in the first column declares one: others are references. A layer's
    last TYPE and the file's last unit hold. text is one technology file.
    """
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "s"))
    named = lines.withColumns({"layer": F.nullif(F.regexp_extract("s", r"^LAYER\s+(\S+)", 1), F.lit("")), "kind": F.nullif(F.regexp_extract("s", r"^\s*TYPE\s+(\S+)\s*;", 1), F.lit(""))})
    owned = named.where("layer is not null or kind is not null").withColumn("ord", F.count("layer").over(Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - 1).where("ord >= 0")
    layers = owned.groupBy("ord").agg(F.min("layer").alias("name"), F.coalesce(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("line"))), F.lit("")).alias("type"))
    unit = lines.select("line", F.regexp_extract("s", rf"^\s*DATABASE\s+MICRONS\s+{NUMBER}\s*;", 1).alias("d")).where("d <> ''")
    return layers.select(F.col("ord").cast("int").alias("ord"), "name", "type"), unit.agg(F.max_by(F.col("d").cast("double"), "line").alias("dbu"))


def _dbu(text: Column, dbu: int) -> Column:
    """Microns as database units, halves up; null where the text is no number."""
    return js_round(text.try_cast("double") * dbu).cast("long")


def masters_of(records: DataFrame, dbu: int) -> DataFrame:
    """name, class, klass, w, h, ox, oy of each MACRO record."""
    v = F.col("value")
    size = F.regexp_extract(v, rf"\bSIZE\s+{NUMBER}\s+BY\s+{NUMBER}", 1), F.regexp_extract(v, rf"\bSIZE\s+{NUMBER}\s+BY\s+{NUMBER}", 2)
    origin = F.regexp_extract(v, rf"\bORIGIN\s+{NUMBER}\s+{NUMBER}", 1), F.regexp_extract(v, rf"\bORIGIN\s+{NUMBER}\s+{NUMBER}", 2)
    number = lambda c: F.coalesce(_dbu(F.nullif(c, F.lit("")), dbu), F.lit(0))
    rows = records.where(v.rlike(r"\bSIZE\s"))
    klass = F.regexp_extract(v, r"\bCLASS\s+(\S+)", 1)
    return rows.select(F.regexp_extract(v, r"^\s*(?:MACRO\s+)?(\S+)", 1).alias("name"), klass.alias("class"), _code(klass, CLASSES, 0).alias("klass"), number(size[0]).alias("w"), number(size[1]).alias("h"), number(origin[0]).alias("ox"), number(origin[1]).alias("oy"), "value")


#: Where a part of a master begins, and within it a layer, or the end of either.
_PART = r"(?m)^(?=[ \t]*(?:PIN\s|OBS\b|END[ \t]+\S))"
_LAYER = r"(?m)^(?=[ \t]*(?:LAYER\s|END[ \t]*\r?$))"


def rects_of(masters: DataFrame, dbu: int, outline: bool = False) -> DataFrame:
    """name, r, layer, fold, flags, x, y, w, h, clamped and what became of each: kept, clipped (to nothing), polygon, malformed (a corner that is no number).

    Corners are put in order, the origin is subtracted, and they are clamped to
    the size. With outline, each master's box comes first, as r = 0. A master is
    parsed and its rects are numbered within its row.
    """

    def shape(lay: Column, pin: Column):
        def made(line: Column) -> Column:
            word = F.split(F.trim(line), r"\s+")
            at = lambda k, o: _dbu(F.get(word, F.lit(k)), dbu) - F.col(o)
            polygon = F.get(word, F.lit(0)) == "POLYGON"
            corner = lambda k, o: F.when(~polygon, at(k, o))
            return F.struct(polygon.alias("polygon"), lay.alias("lay"), pin.alias("pin"), corner(1, "ox").alias("a"), corner(2, "oy").alias("b"), corner(3, "ox").alias("c"), corner(4, "oy").alias("e"))

        return made

    def of_layer(pin: Column):
        def found(text: Column) -> Column:
            lay = F.upper(F.nullif(F.regexp_extract(text, r"^\s*LAYER\s+(\S+)", 1), F.lit("")))
            lines = F.regexp_extract_all(text, F.lit(rf"(?m)^[ \t]*((?:POLYGON\b|RECT(?:\s+{NUMBER}){{4}})[^\n]*)"), F.lit(1))
            return F.transform(lines, shape(lay, pin))

        return found

    def of_part(text: Column) -> Column:
        return F.flatten(F.transform(F.split(text, _LAYER), of_layer(text.rlike(r"^\s*PIN\s"))))

    def boxed(s: Column) -> Column:
        low, high = (lambda p, q: F.least(s[p], s[q])), (lambda p, q: F.greatest(s[p], s[q]))
        inside = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.col(most))
        return F.struct(s["polygon"].alias("polygon"), s["lay"].alias("lay"), s["pin"].alias("pin"), *(f(p, q).alias(n) for n, f, p, q in (("u0", low, "a", "c"), ("v0", low, "b", "e"), ("u1", high, "a", "c"), ("v1", high, "b", "e"))), *(inside(f(p, q), most).alias(n) for n, f, p, q, most in (("x0", low, "a", "c", "w"), ("y0", low, "b", "e", "h"), ("x1", high, "a", "c", "w"), ("y1", high, "b", "e", "h"))), (s["a"].isNull() | s["b"].isNull() | s["c"].isNull() | s["e"].isNull()).alias("bad"))

    area = lambda s: ~s["polygon"] & ~s["bad"] & (s["x1"] > s["x0"]) & (s["y1"] > s["y0"])
    rows = masters.withColumn("_s", F.flatten(F.transform(F.split("value", _PART), of_part))).withColumn("_b", F.transform("_s", boxed))
    first = 1 if outline else 0
    kept = F.transform(F.filter("_b", area), lambda s, i: F.struct((i + first).alias("r"), s.alias("s")))
    other = F.transform(F.filter("_b", lambda s: ~area(s)), lambda s: F.struct(F.lit(None).cast("int").alias("r"), s.alias("s")))
    box = rows.select("name", F.explode(F.concat(kept, other)).alias("k")).select("name", "k.r", "k.s.*")
    fate = F.when(F.col("polygon"), "polygon").when(F.col("bad"), "malformed").when(F.col("r").isNotNull(), "kept").otherwise("clipped")
    known, folded = _code(F.col("lay"), LAYERS, None), _code(F.col("lay"), FOLDED, None)
    clamped = F.coalesce(F.expr("x0 <> u0 or y0 <> v0 or x1 <> u1 or y1 <> v1"), F.lit(False))
    fold = F.when(known.isNotNull(), "known").when(folded.isNotNull(), "folded").otherwise("unknown")
    out = box.select("name", "r", F.coalesce(known, folded, F.lit(UNKNOWN)).alias("layer"), fold.alias("fold"), F.col("pin").cast("int").alias("flags"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.expr("x1 - x0").alias("w"), F.expr("y1 - y0").alias("h"), clamped.alias("clamped"), fate.alias("fate"))
    if outline:
        own = masters.selectExpr("name", "0 AS r", "0 AS layer", "'known' AS fold", "0 AS flags", "0L AS x", "0L AS y", "w", "h", "false AS clamped", "'kept' AS fate")
        out = own.unionByName(out)
    return out


def statistics(masters: DataFrame, rects: DataFrame) -> DataFrame:
    """(what, key, n) of a library: masters by class, with an origin, pins; rects kept by part and layer fold, clamped, dropped, polygons."""
    def counts(rows: DataFrame, *of: tuple) -> DataFrame:
        each = (F.struct(F.lit(what).alias("what"), (key if isinstance(key, Column) else F.lit(key)).alias("key"), n.cast("int").alias("n")) for what, key, n in of)
        return rows.select(F.explode(F.array(*each)).alias("s")).select("s.*")

    v, one, kept = F.col("value"), F.lit(1), F.col("fate") == "kept"
    pins, lines = F.size(F.regexp_extract_all(v, F.lit(r"(?m)^\s*(PIN)\s"), F.lit(1))), F.size(F.split(v, "\n"))
    per = counts(masters, ("class", F.col("class"), one), ("origin", "not zero", F.expr("ox <> 0 or oy <> 0")), ("pins", "all", pins), ("lines", "all", lines))
    fate = F.when(kept, F.when(F.col("flags") == 1, "pin").otherwise("obs")).otherwise(F.col("fate"))
    of = counts(rects, ("rects", fate, one), ("fold", F.col("fold"), kept), ("clamped", "all", F.col("clamped")))
    return per.unionByName(of).groupBy("what", "key").agg(F.sum("n").alias("n")).where("n > 0")


def design_units(statements: DataFrame) -> DataFrame:
    """dbu, x0, y0, x1, y1 of a design."""
    word = _words(F.col("value"))
    area = F.when(F.get(word, F.lit(0)) == "DIEAREA", F.regexp_extract_all("value", F.lit(r"(-?\d+)"), F.lit(1)))
    cols = {"dbu": F.when(F.array_join(F.slice(word, 1, 3), " ") == "UNITS DISTANCE MICRONS", F.get(word, F.lit(3)).cast("double")), **{n: F.get(area, F.lit(i)).cast("long") for i, n in enumerate(("x0", "y0", "x1", "y1"))}}
    return statements.select(*(c.alias(n) for n, c in cols.items())).agg(*(F.max(n).alias(n) for n in cols))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def in_section(statements: DataFrame, name: str) -> DataFrame:
    """The statements of a design's section, without the one that opens it; their order is by (file, at).

    The few that open or close a section give its spans, which are broadcast.
    """
    v = F.col("value")
    opens, closes = v.rlike(rf"(?m)^[ \t]*{name}\s+\d+\s*$"), v.rlike(rf"(?m)^[ \t]*END\s+{name}\b")
    marks = statements.where(v.contains(name) & (opens | closes)).select(F.col("file").alias("_file"), F.col("at").alias("_from"), closes.alias("_closed"))
    after = F.lead("_from").over(Window.partitionBy("_file").orderBy("_from"))
    spans = marks.withColumn("_to", after).where("not _closed")
    inside = (F.col("file").eqNullSafe(F.col("_file"))) & (F.col("at") > F.col("_from")) & (F.col("_to").isNull() | (F.col("at") < F.col("_to")))
    return statements.join(F.broadcast(spans), inside, "left_semi")


def components(statements: DataFrame) -> DataFrame:
    """name, master, status, x, y, orient of a design's components; unplaced ones have no place.

    Statements of other sections (blockages, groups, pins, nets) aren't components,
    whatever they look like. Without a status a component is unplaced; of several
    the last holds.
    """
    v = F.col("value")
    rows = in_section(statements, "COMPONENTS").where(v.rlike(r"^\s*-\s"))
    head = F.split(F.regexp_replace(v, r"^\s+", ""), r"\s+", 4)
    rows = rows.select(head.alias("head")).where((F.get("head", F.lit(0)) == "-") & (F.get("head", F.lit(2)) != ""))
    rows = rows.select(F.get("head", F.lit(1)).alias("name"), F.get("head", F.lit(2)).alias("master"), F.coalesce(F.get("head", F.lit(3)), F.lit("")).alias("rest"))
    # What begins with the last status word, as words.
    tail = F.element_at(F.split("rest", r"(?<!\S)(?=(?:FIXED|PLACED|COVER|UNPLACED)(?!\S))"), -1)
    rows = rows.withColumn("word", F.split(tail, r"\s+"))
    stated = F.get("word", F.lit(0))
    rows = rows.withColumn("status", F.when(stated.isin("FIXED", "PLACED", "COVER"), stated).otherwise("UNPLACED"))
    placed, there = F.col("status") != "UNPLACED", F.get("word", F.lit(1)) == "("
    number = lambda n: F.when(placed, F.when(there, F.get("word", F.lit(n)).try_cast("long")).otherwise(0))
    return rows.select("name", "master", "status", number(2).alias("x"), number(3).alias("y"), F.when(placed, F.when(there, F.get("word", F.lit(5))).otherwise("N")).alias("orient"))


def rows_of(statements: DataFrame) -> DataFrame:
    """name, site, x, y, orient, nx, ny, step, step_y of row statements."""
    word = _words(F.col("value"))
    rows = statements.select(word.alias("w")).where(F.get("w", F.lit(0)) == "ROW").where(F.get("w", F.lit(6)) == "DO")
    at = lambda k: F.get("w", F.lit(k))
    number = lambda k: at(k).try_cast("long")
    return rows.select(at(1).alias("name"), at(2).alias("site"), number(3).alias("x"), number(4).alias("y"), at(5).alias("orient"), number(7).alias("nx"), number(9).alias("ny"), number(11).alias("step"), number(12).alias("step_y"))


def to_units(value: Column, lef_dbu: Column | int, def_dbu: Column | int) -> Column:
    """A library length in the design's units."""
    return js_round(value * def_dbu / lef_dbu).cast("long")
