"""Scratch tables in the shared folder, salted ranks and distributed union-find."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


@atexit.register
def _forget() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where it is unset: a folder under the warehouse on a cluster, a temporary
    folder (removed at exit) with a local master.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lamina-"))
        return "file://" + _OWN[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Parquet tables in the shared folder: they cut the lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.schemas: dict = {}

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Stores df, in folders by a column where one is given."""
        path = f"{self.root}/{name}"
        to = df.write.option("compression", "zstd")
        (to.partitionBy(by) if by else to).parquet(path)
        self.schemas[name] = df.schema
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Deletes all tables but those named."""
        self.drop(*(set(self.schemas) - set(names)))


def tidy(spark: SparkSession) -> None:
    """Gives back what nothing refers to any more: shuffle files of ended jobs, on all executors, and memory of the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int | None = None, share: int = 1000) -> DataFrame:
    """rows joined with keyed, which has one row for each key, and how many of rows there are of it.

    Keys with more than 1/share of all rows, so fewer than share of them, are
    broadcast; the others are dealt out by key, none of which is large. Both
    inputs are read twice, so pass stored tables; total is the count's sum.
    """
    total = total if total is not None else keyed.agg(F.sum(count)).first()[0] or 0
    large = F.broadcast(keyed.where(F.col(count) * share > total))
    small = keyed.where(F.col(count) * share <= total)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key))


def salted_rank(df: DataFrame, group: list[str], tie: str, out: str, rows: int, per_bucket: int = 4096) -> DataFrame:
    """0-based gapless rank of each row inside its group, by (hash bucket of tie, tie).

    A group may hold any share of the rows: it is dealt over hash buckets, which
    are ranked alone and shifted by a running sum of the buckets' counts. df is
    read twice, so pass a stored table; rows is its row count.
    """
    buckets = max(1, -(-rows // per_bucket))
    df = df.withColumn("_b", F.pmod(F.xxhash64(tie), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*group, "_b").orderBy(tie)
    ranked = df.withColumn("_r", F.row_number().over(inside))
    return ranked.join(starts, [*group, "_b"]).withColumn(out, F.col("_s") + F.col("_r") - 1).drop("_b", "_s", "_r")


def connected_components(edges: DataFrame, scratch: Scratch, label: str, rounds: int = 64) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Large-star and small-star contractions until nothing changes. Hubs are safe:
    minima are combined before the shuffle, and joined with hubs by broadcast.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = scratch.write(now, f"{label}0"), None
    n = now.count()
    for i in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        star = join_by_key(both, low, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        rest = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.write(nxt, f"{label}{i}")
        scratch.drop(f"{label}{i - 1}")
        n, s = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = nxt
        if (n, s) == mark:
            break
        mark = (n, s)
    else:
        raise RuntimeError(f"no fixpoint after {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
