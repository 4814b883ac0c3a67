import os

import pytest

from lamina.operators import pyramid as P
from lamina.sources import store
from lamina.sources.tables import Design

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_tiles_round_trip_and_prune(spark, tmp_path):
    d = Design(spark, SF)
    path = str(tmp_path / "tiles")
    store.write_tiles(d, path)
    back = spark.read.parquet(path)
    cols = ["z", "tx", "ty", "is_overflow", "bucket", "pno", "lx", "ly", "m", "o"]
    assert store.tile_rows(d).select(*cols).exceptAll(back.select(*cols)).count() == 0
    assert back.count() == store.tile_rows(d).count()
    part = store.read_tiles(spark, path, d.max_z, 1, 1, 2, 2)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(z" in plan and "GreaterThanOrEqual(tx,1)" in plan
    want = P.tiled(d).where("tx between 1 and 2 and ty between 1 and 2").where(f"not 4 * greatest(w, h) > {d.tile}").count()
    assert part.count() == want > 0


def test_manifest_and_catalog(spark, tmp_path):
    d = Design(spark, SF)
    for name in ("b", "a"):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "manifest.json").write_text(store.manifest(d).first().value)
        (tmp_path / name / "x.bin").write_bytes(b"12345")
    os.makedirs(tmp_path / "none")
    (tmp_path / "none" / "x.bin").write_bytes(b"1")
    (tmp_path / "a" / "deep").mkdir()
    (tmp_path / "a" / "deep" / "manifest.json").write_text("12")
    index = str(tmp_path) + "-catalog"

    def refreshed():
        rows, read = store.catalog(spark, str(tmp_path), index)
        return {r.name: (r.placements, r.files, r.bytes) for r in rows.collect()}, read

    def touch(name, text, at):
        path = tmp_path / name / "manifest.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
        os.utime(path, (at, at))

    size = len(store.manifest(d).first().value)
    first = {"a": (d.n, 3, size + 7), "b": (d.n, 2, size + 5)}
    assert refreshed() == (first, 2) and refreshed() == (first, 0)
    # Only what changed is read: another manifest, a new design with odd letters, one that can't be read.
    touch("b", store.manifest(d).first().value.replace(f'"placements":{d.n}', '"placements":7'), 2_000_000_000)
    touch("c [1]", store.manifest(d).first().value, 2_000_000_000)
    touch("none", "{broken", 2_000_000_000)
    got, read = refreshed()
    assert read == 3 and set(got) == {"a", "b", "c [1]"} and got["b"][0] == 7 and got["a"] == first["a"]
    # A file that grows without its manifest is measured when that changes; designs that went are gone.
    (tmp_path / "a" / "x.bin").write_bytes(b"123456789")
    os.remove(tmp_path / "b" / "manifest.json")
    got, read = refreshed()
    assert read == 0 and set(got) == {"a", "c [1]"} and got["a"] == first["a"]
    assert store.catalog(spark, str(tmp_path / "nowhere"), index + "2")[0].collect() == []
    m = store.read_manifest(spark.read.text(str(tmp_path / "a" / "manifest.json"))).first()
    assert m.max_z == d.max_z and m.placements == d.n and len(m.levels) == d.max_z + 1
    bad = store.manifest(d).selectExpr("replace(value, '\"version\":4', '\"version\":3') AS value")
    with pytest.raises(Exception, match="another manifest version"):
        store.read_manifest(bad).collect()
