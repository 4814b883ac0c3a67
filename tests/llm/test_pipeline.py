"""Each stage against its operator, over a small table of planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(8)
    words = [a + b for a in ("tha", "ere", "ion", "ing") for b in ("nt", "st", "nd", "re", "ly")]
    docs = [(i, "\n".join(" ".join(r.choice(words) for _ in range(20)) for _ in range(3)), "en", "s", 0) for i in range(120)]
    docs = [(i, t + "\nvermin scum vermin" if i % 4 == 0 else t, l, s, len(t)) for i, t, l, s, _ in docs]
    docs += [(200, "12 34 !!", "en", "s", 8), (201, None, "en", "s", None), (202, docs[1][1], "en", "s", 5)]
    near = docs[2][1].split("\n")
    docs.append((203, "\n".join(x.rsplit(" ", 1)[0] + " changed" for x in near), "en", "s", 5))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {200, 201} & set(seen["language_id"]) and len(seen["language_id"]) == 122
    toxic = {i for i in range(120) if i % 4 == 0}
    assert len(toxic & set(seen["toxicity"])) <= 3 and len(set(seen["toxicity"])) >= 85
    # 202 is a copy of 1, 203 nearly one of 2: no line of them is left, so they go; all others keep words.
    assert set(seen["toxicity"]) - set(seen["line_dedup"]) == {202, 203} and all(t.strip() for t in seen["line_dedup"].values())
    packed = corpus_pipeline.pack(spark, docs, tables).collect()
    assert {r.doc_id for r in packed} == set(seen["ngram_jaccard_join"])
    assert corpus_pipeline.run(spark, tables).count() == len(packed)


def test_join_keeps_one_of_a_group(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (9, "other words"), (7, "")]
    got = corpus_pipeline.join_ngrams(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [2, 7, 9]


def odd(spark):
    line = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"
    rows = [(1, None), (2, ""), (3, " \n"), (4, line), (4, line), (5, line), (None, line), (None, None), (6, f"{line}\nother words that nobody else has written here"), (7, "x" * 100_000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kind)
    return df.selectExpr("*", "1 AS had", "2 AS HAD_", "3 AS gone", "4 AS component_id", "5 AS score", "6 AS `a.b`", "7 AS _row")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, tables, stage):
    docs = odd(spark)
    out = stage(spark, docs, tables)
    got = sorted(((r.doc_id or 0), r.text or "") for r in out.collect()) if "text" in out.columns else sorted((r.doc_id or 0) for r in out.collect())
    every = sorted(((r.doc_id or 0), r.text or "") for r in docs.collect())
    if stage is corpus_pipeline.pack:
        assert set(got) == {i for i, _ in every} and len(got) >= len(every)
        return
    assert out.columns == docs.columns
    if stage is corpus_pipeline.language_id:
        assert got == [x for x in every if x[0] in (0, 4, 5, 6, 7) and x[1]]
    elif stage is corpus_pipeline.toxic:
        assert got == every
    elif stage is corpus_pipeline.dedup_lines:
        assert got == sorted([x for x in every if x[0] not in (5, 6)] + [(6, "other words that nobody else has written here")])
    else:
        assert got == [x for x in every if x[0] != 5]
    assert stage(spark, docs.limit(0), tables).collect() == []
