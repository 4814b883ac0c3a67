"""Fill-in-middle against a plain version, and the exact round trip."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lamina.llm.fim import BLOCK, fill_in_middle, restore


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def rows():
    sizes = [0, 1, 2, 3, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 3 * BLOCK + 5, 1000]
    alphabet = "a<PSM>é日😀\n \\E\\Q\x00"
    out = [(k, "".join(alphabet[(k * 7 + j * j) % len(alphabet)] for j in range(sizes[k % len(sizes)]))) for k in range(400)]
    out += [(1000 + k, "x" * sizes[k % len(sizes)]) for k in range(200)]
    return [*out, (None, "text without an id"), (5000, None), (5001, "has <M> inside"), (5002, "<P"), (5002, "<P"), (5003, "word " * 40_000), (-7, "<S"), (5004, "a\r\n b" * 50)]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS form", "2 AS _u", "3 AS _lo")
    return restore(fill_in_middle(df)).collect()


def test_as_the_plain_version(got):
    want = [(i, *plain(i, t)) for i, t in rows()]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_round_trip(got):
    assert sorted(((r.doc_id, r.restored) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows()), key=repr)


def test_empty_table_and_names_that_clash(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert restore(fill_in_middle(empty)).collect() == []
    odd = fill_in_middle(spark.createDataFrame([(1, "some text")], "doc_id long, text string")).withColumn("_outer", F.lit(4))
    assert restore(odd).select("restored", "_outer").collect()[0] == ("some text", 4)


def test_no_python_and_no_shuffle(spark):
    df = restore(fill_in_middle(spark.createDataFrame(spark.range(3).selectExpr("id AS doc_id", "'abc' AS text").schema and [(1, "a")], "doc_id long, text string")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_odd_forms_give_null(spark):
    df = spark.createDataFrame([("<P>a<S>b<M>c", "psm"), ("<S>b<P>a<M>c", "spm"), ("x", "plain"), (None, "psm"), ("x", None), ("x", "other")], "output string, form string")
    assert [r.restored for r in restore(df).collect()] == ["acb", "acb", "x", None, None, None]
