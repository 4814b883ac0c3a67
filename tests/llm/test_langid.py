import random

import numpy as np
from pyspark.sql import functions as F

from lamina.llm.langid import SWITCH, _scripts, held_out, identify, learn, viterbi

WORDS = {"aa": ["thing", "other", "wether", "shound", "nother"], "bb": ["schlich", "keitung", "gericht", "einsch", "verdie"], "ru": ["привет", "словами", "дорога", "погода", "новости"]}


def corpus(n=60, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(30)), lang) for i, lang in ((i, sorted(WORDS)[i % 3]) for i in range(n))]


def brute(w, switch):
    """Best path by plain dynamic programming over one text."""
    v, back = w[0].copy(), []
    for row in w[1:]:
        best = int(v.argmax())
        stay = v >= v[best] - switch
        back.append(np.where(stay, np.arange(len(v)), best))
        v = np.maximum(v, v[best] - switch) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_of_several_texts():
    r = np.random.default_rng(3)
    texts = [r.normal(0, 8, (int(n), 4)) for n in r.integers(1, 40, 20)]
    for got, w in zip(viterbi(texts, 12.0), texts, strict=True):
        want = brute(w, 12.0)

        def score(p, w=w):
            return sum(w[i, k] for i, k in enumerate(p)) - 12.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))

        assert np.isclose(score(list(got)), score(want))


def test_accuracy_spans_and_odd_rows(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = learn(docs)
    assert model.langs == ["aa", "bb", "ru"]
    mixed = "thing other nother wether shound thing other " * 3 + "gericht keitung einsch schlich verdie " * 2
    rows = [(1, None), (2, ""), (3, " 12 %$ —  "), (4, "THING Other"), (5, mixed), (6, "дорога"), (7, "ª"), (8, "thing " * 40_000), (None, "gericht")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS spans", "0 AS lang_pred")
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 8, None)] == ["und", "und", "und", "aa", "aa", "ru", "aa", "bb"]
    assert all(got[i].score == 0 and got[i].spans == [] for i in (1, 2, 3))
    assert [s.lang for s in got[5].spans] == ["aa", "bb"] and 0.4 < got[5].score < 0.8
    assert mixed.encode()[got[5].spans[1].start : got[5].spans[1].end].decode().startswith("gericht")
    assert all(0 <= r.score <= 1 for r in got.values()) and SWITCH > 0


def test_nothing_learned_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = learn(none)
    assert identify(none, model).collect() == []
    assert identify(spark.createDataFrame([(1, "words")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(300, 9), "doc_id long, text string, lang string")
    model = learn(docs.where(~held_out(5, 0)))
    out = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(5, 0))
    assert out.count() > 20 and out.where(F.col("lang") != F.col("lang_pred")).count() == 0


def test_labels_of_many_languages():
    """A label is the language's number, however many there are."""
    r = np.random.default_rng(5)
    w = r.normal(0, 1, (30, 300))
    w[:12, 290] += 20
    w[12:, 150] += 20
    assert list(viterbi([w], 5.0)[0]) == [290] * 12 + [150] * 18


def test_scripts_by_code_point():
    """Letters of one lead byte in UTF-8 can be of several scripts."""

    def of(word):
        by = _scripts(np.frombuffer(word.encode(), np.uint8))
        return 0 if by is None else int(by.max())

    assert of("straße") == of("tiếng") == 0
    assert len({of(x) for x in ("日本", "にほん", "ภาษา", "हिन्दी", "தமிழ்", "ქართ", "አማር", "한글", "ευ", "мир", "𐍈")}) == 11
