import random
import time

from lamina.llm import shared
from lamina.llm.shared import Scratch, connected_components, salted_rank


def test_components_of_paths_stars_and_hubs(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(200, 400)] + [(7, 7)] + [(r.randint(500, 560), r.randint(500, 560)) for _ in range(40)]
    comp = {}

    def find(a):
        comp.setdefault(a, a)
        while comp[a] != a:
            a = comp[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "cc")
    assert {r.node: r.component for r in got.collect()} == {a: find(a) for a in comp}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "cc").collect() == []


def test_salted_rank_is_gapless(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "id AS t")
    got = salted_rank(df, ["g"], "t", "r", 5000, 64).toPandas()
    assert all(sorted(x.r) == list(range(len(x))) for _, x in got.groupby("g"))


def test_tidy_deletes_shuffles_of_ended_jobs(spark, tmp_path):
    """Without it they stay until the driver happens to collect garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shared.tidy(spark)
    time.sleep(2)
    before = blocks.getAllFiles().size()
    spark.range(100_000).selectExpr("id % 1000 AS k").repartition(4, "k").write.parquet(f"{tmp_path}/x")
    assert blocks.getAllFiles().size() > before
    for _ in range(20):
        shared.tidy(spark)
        time.sleep(0.5)
        if blocks.getAllFiles().size() <= before:
            return
    raise AssertionError("shuffle files are left")
