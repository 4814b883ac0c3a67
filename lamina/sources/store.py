"""The pyramid as tables on disk: tiles by level, sorted by key, and a manifest in JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import pyramid as P
from . import binary as B
from .scratch import drop
from .tables import Design

MANIFEST = "version int, max_z int, tile long, world long, placements long, caps array<long>, levels array<struct<z: int, kind: string, tiles: long, p95: long>>"
VERSION = 4


def tile_rows(d: Design) -> DataFrame:
    """Records of every deep and mid level and of their overflow lists (tx, ty null), with their buckets on deep ones."""
    rows = P.placement_rows(d)
    own = lambda c: F.when(~F.col("is_overflow"), F.col(c))
    return rows.select("z", own("tx").alias("tx"), own("ty").alias("ty"), "is_overflow", F.when(F.col("bucket") >= 0, F.col("bucket")).alias("bucket"), "pno", "lx", "ly", "m", "o")


def write_tiles(d: Design, path: str) -> None:
    """One directory per level; ranges of tile keys in order, so that row groups prune by tile."""
    parts = max(1, int(d.spark.conf.get("spark.sql.shuffle.partitions")))
    rows = tile_rows(d).repartitionByRange(parts, "z", "ty", "tx").sortWithinPartitions("z", "ty", "tx", "bucket", "pno")
    rows.write.partitionBy("z").parquet(path)


def read_tiles(spark: SparkSession, path: str, z: int, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Records of a rectangle of tiles of one level."""
    t = spark.read.parquet(path).where(F.col("z") == z)
    return t.where(F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1))


def produce(d: Design, index: DataFrame, wanted: DataFrame, kinds: DataFrame) -> DataFrame:
    """Records of the wanted tiles (z, tx, ty) of deep and mid levels, from the index: z, tx, ty, bucket, lx, ly, m, o.

    Only bytes of the deepest tiles below them are read: their bounding box is
    pushed down to the index, and what it holds beyond them goes by key. A tile
    without records has one row with nulls, so that it counts as made.
    """
    w = wanted.join(F.broadcast(kinds.where("kind <> 'far'").select("z", "kind")), "z").distinct()
    up = f"({d.max_z} - z)"
    box = w.agg(*(f(F.expr(e)) for f, e in ((F.min, f"shiftleft(tx, {up})"), (F.min, f"shiftleft(ty, {up})"), (F.max, f"shiftleft(tx + 1, {up}) - 1"), (F.max, f"shiftleft(ty + 1, {up}) - 1")))).first()
    near = index.where(F.col("tx").between(box[0] or 0, -1 if box[2] is None else box[2]) & F.col("ty").between(box[1] or 0, -1 if box[3] is None else box[3]))
    levels = sorted(r["z"] for r in w.select("z").distinct().collect())
    at = F.array(*(F.lit(z) for z in levels)) if levels else F.array().cast("array<int>")
    rows = near.withColumn("z", F.explode(at)).withColumns({"tx": F.expr(f"shiftright(tx, {d.max_z} - z)"), "ty": F.expr(f"shiftright(ty, {d.max_z} - z)"), "ztile": F.expr(f"{d.tile}L * shiftleft(1L, {d.max_z} - z)")})
    found = rows.join(w, ["z", "tx", "ty"]).join(d.masters.select("m", "w", "h", "rc"), "m").where("4 * greatest(w, h) <= ztile")
    bucket = F.when(F.col("kind") == "deep", G.bucket_of(F.col("rc"), P.CAPS))
    made = found.select("z", "tx", "ty", bucket.alias("bucket"), F.expr("x - tx * ztile").alias("lx"), F.expr("y - ty * ztile").alias("ly"), "m", "o")
    return w.select("z", "tx", "ty").join(made, ["z", "tx", "ty"], "left")


def serve(d: Design, index: DataFrame, requests: DataFrame, path: str, kinds: DataFrame) -> tuple[DataFrame, int]:
    """Records of the requested tiles (z, tx, ty) and how many tiles had to be made.

    Tiles that the store at path lacks are produced from the index and appended;
    then all are read from it, so no tile is ever made twice. Batches are served
    one after another; a batch's own repeated requests are made once.
    """
    spark = d.spark
    schema = "tx long, ty long, bucket int, lx long, ly long, m long, o int, z int"
    asked = requests.select(F.col("z").cast("int").alias("z"), "tx", "ty").distinct()
    there = _exists(spark, path)
    stored = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    missing = asked.join(stored.select("z", "tx", "ty").distinct(), ["z", "tx", "ty"], "left_anti") if there else asked
    side = F.expr("shiftleft(1L, z)")
    missing = missing.where((F.col("z").between(0, d.max_z)) & (F.col("tx") >= 0) & (F.col("ty") >= 0) & (F.col("tx") < side) & (F.col("ty") < side))
    keys = [tuple(r) for r in missing.join(F.broadcast(kinds.where("kind <> 'far'").select("z")), "z").groupBy("z").agg(F.count(F.lit(1))).collect()]
    made = sum(n for _, n in keys)
    if made:
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = produce(d, index, missing, kinds).repartition(parts, "z", "tx", "ty").sortWithinPartitions("z", "ty", "tx", "bucket")
        rows.write.mode("append").partitionBy("z").parquet(path)
        stored = spark.read.schema(schema).parquet(path)
    return stored.join(asked, ["z", "tx", "ty"], "left_semi").where("m is not null"), made


def chosen(tiles: DataFrame, kinds: DataFrame, level: int | None = None, region: tuple[int, int, int, int] | None = None, every: int = 1) -> DataFrame:
    """Of the tiles that exist (z, tx, ty) those to make ahead: z, tx, ty of one deep or mid level or all, in a region of its tiles, one in so many.

    The region's corners belong to it. Tiles count by rows from each level's
    first in the region; rows are numbered by themselves and shifted by the rows
    before, so no window sees a level's tiles. Another level is an error.
    """
    lazy = kinds.where("kind <> 'far'").select("z")
    if level is not None:
        lazy = lazy.where(F.col("z") == level)
        if lazy.isEmpty():
            raise ValueError(f"level {level} isn't made on demand")
    t = tiles.select("z", "tx", "ty").distinct().join(F.broadcast(lazy), "z")
    if region is not None:
        x0, y0, x1, y1 = region
        t = t.where(F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1))
    if every > 1:
        before = Window.partitionBy("z").orderBy("ty").rowsBetween(Window.unboundedPreceding, -1)
        rows = t.groupBy("z", "ty").agg(F.count(F.lit(1)).alias("n")).select("z", "ty", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        inside = F.row_number().over(Window.partitionBy("z", "ty").orderBy("tx")) - 1
        t = t.withColumn("i", inside).join(rows, ["z", "ty"]).where((F.col("first") + F.col("i")) % every == 0)
    return t.select("z", "tx", "ty")


def materialise(d: Design, index: DataFrame, wanted: DataFrame, path: str, kinds: DataFrame, dry_run: bool = False) -> DataFrame:
    """z, kind, tiles, records, bytes of the wanted tiles, which are in the store at path afterwards; a dry run makes them and keeps none.

    Bytes are those of the tiles as files. Tiles that hold nothing don't count.
    """
    rows = produce(d, index, wanted, kinds).where("m is not null") if dry_run else serve(d, index, wanted, path, kinds)[0]
    each = rows.groupBy("z", "tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bucket").alias("buckets"))
    size = B.TILE_HEADER.itemsize + F.col("buckets") * B.BUCKET.itemsize + F.col("n") * B.PLACEMENT.itemsize
    out = each.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("records"), F.sum(size).alias("bytes"))
    return out.join(F.broadcast(kinds.select("z", "kind")), "z").select("z", "kind", "tiles", "records", "bytes")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def _glob(spark: SparkSession, pattern: str) -> list:
    return [f.getPath() for f in _fs(spark, pattern).globStatus(_path(spark, pattern)) or []]


def manifest(d: Design) -> DataFrame:
    """One row with the manifest as JSON."""
    levels = P.level_kinds(d).agg(F.sort_array(F.collect_list(F.struct("z", "kind", "tiles", "p95"))).alias("levels"))
    scalars = {"version": F.lit(VERSION), "max_z": F.lit(d.max_z), "tile": F.lit(d.tile).cast("long"), "world": F.lit(d.world).cast("long"), "placements": F.lit(d.n).cast("long"), "caps": F.array(*(F.lit(c).cast("long") for c in P.CAPS))}
    return levels.select(F.to_json(F.struct(*(c.alias(n) for n, c in scalars.items()), "levels")).alias("value"))


def read_manifest(docs: DataFrame) -> DataFrame:
    """Manifests from JSON text (value); another version is an error."""
    m = docs.select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    return m.where(F.assert_true(F.col("version") == VERSION, F.lit("another manifest version")).isNull())


def catalog(spark: SparkSession, root: str, index: str) -> tuple[DataFrame, int]:
    """Designs of a folder by name (name, modified, placements, max_z, levels, far, bytes, files), and how many were read.

    A design is a folder with a manifest. What was learned of each is kept in a
    table at index with the time of its manifest; only designs whose manifest
    has another time are read and measured again, those that went are left out,
    and so are those whose manifest can't be read. A table is current once it
    is complete, so a refresh that breaks off changes nothing.
    """
    base = _fs(spark, root).makeQualified(_path(spark, root)).toString().rstrip("/")
    versions = sorted(int(p.getParent().getName().removeprefix("v-")) for p in _glob(spark, f"{index}/v-*/_SUCCESS"))
    known = spark.read.schema(_ENTRY).parquet(f"{index}/v-{versions[-1]}") if versions else spark.createDataFrame([], _ENTRY)
    if _glob(spark, f"{base}/*/manifest.json"):
        listed = spark.read.format("binaryFile").load(f"{base}/*/manifest.json").select(_design(base).alias("name"), F.col("modificationTime").alias("modified"))
    else:
        listed = known.select("name", "modified").where("false")
    same = known.join(listed, ["name", "modified"], "left_semi")
    # Paths to read are a list on the driver, as those of any read.
    changed = [r["name"] for r in listed.join(known, ["name", "modified"], "left_anti").select("name").collect()]
    entries = same.unionByName(_entries(spark, base, changed)) if changed else same
    if changed or versions and known.count() != same.count() or not versions:
        new = versions[-1] + 1 if versions else 0
        entries.select(*known.columns).write.parquet(f"{index}/v-{new}")
        for v in versions[:-1]:
            drop(spark, f"{index}/v-{v}")
        known = spark.read.schema(_ENTRY).parquet(f"{index}/v-{new}")
    return known.where("placements is not null").orderBy("name"), len(changed)


_ENTRY = "name string, modified timestamp, placements long, max_z int, levels int, far int, bytes long, files long"


def _entries(spark: SparkSession, base: str, names: list[str]) -> DataFrame:
    """What manifests and files of designs say."""
    dirs = [base + "/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in names]
    m = spark.read.format("binaryFile").load([d + "/manifest.json" for d in dirs])
    m = m.select(_design(base).alias("name"), F.col("modificationTime").alias("modified"), F.from_json(F.col("content").cast("string"), MANIFEST).alias("m"))
    m = m.select("name", "modified", "m.placements", "m.max_z", F.size("m.levels").alias("levels"), F.size(F.filter("m.levels", lambda z: z["kind"] == "far")).alias("far"))
    size = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(dirs).groupBy(_design(base).alias("name")).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
    return m.join(size, "name")


def _design(base: str) -> Column:
    """The first folder below base of a path."""
    return F.substring_index(F.expr(f"substr(path, {len(base) + 2})"), "/", 1)
