import random

from pyspark.sql import functions as F

from lamina.llm import line_dedup as line_dedup_module
from lamina.llm.line_dedup import line_dedup

LINE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_first_line_stays(spark):
    rows = [(2, f"{LINE}\nother words entirely in here"), (1, f"alpha beta gamma delta\n{LINE}"), (3, LINE.replace("lazy", "hazy") + "\n\nend of text")]
    got = texts(line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {1: rows[1][1], 2: "other words entirely in here", 3: "\nend of text"}


def test_threshold(spark):
    """Exact Jaccard of 5-character shingles decides, not the signature."""
    a = LINE
    far = " ".join(w if k % 3 else w[::-1] for k, w in enumerate(LINE.split()))
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in (a, far)]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    got = texts(line_dedup(spark.createDataFrame([(1, a), (2, far)], "doc_id long, text string")))
    assert got == {1: a, 2: far}


def test_lines_without_spaces_and_short_lines(spark):
    """An edit in the first characters of a line without white space, or in the last word of a short line, hides no pair."""
    r = random.Random(3)
    han = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(2000))
    rows = [(1, han), (2, han[:2] + "x" + han[3:]), (3, "Navigation menu"), (4, "Navigation menus"), (5, "Terms"), (6, "https://" + han[:80:2]), (7, "http://" + han[:80:2])]
    got = texts(line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {k: v if k in (1, 3, 5, 6) else "" for k, v in rows}


def test_recall_at_random_edits(spark):
    """Of pairs that edits bring near the threshold nearly all are found, whatever the length and the script."""
    r, rows = random.Random(4), []
    for alphabet in ("abcdefghijklmnop ", [chr(0x4E00 + i) for i in range(2000)], "abcdefghijklmnopqrstuvwxyz0123456789-/."):
        for n in (16, 30, 60, 120, 300):
            for _ in range(40):
                x = "x" + "".join(r.choice(alphabet) for _ in range(n)) + "x"
                y = list(x)
                while True:
                    z = y[:]
                    z[r.randrange(1, n + 1)] = r.choice(alphabet)
                    a, b = ({"".join(v)[k : k + 5] for k in range(n - 2)} for v in (x, z))
                    if len(a & b) < 0.8 * len(a | b):
                        break
                    y = z
                rows += [(2 * len(rows), x), (2 * len(rows) + 1, "".join(y))]
    got = texts(line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(x == "" for x in got.values()) >= 0.98 * len(rows) / 2


def test_rest_of_a_band(spark):
    """Pairs of one template are found, though their signatures may hold nothing but the template and an unrelated line comes first."""
    r, rows = random.Random(6), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    template = "".join(r.choice(letters + "  ") for _ in range(103))
    for i in range(60):
        name = "".join(r.choice(letters) for _ in range(20))
        rows += [(2 * i, f"x{template} {name}"), (2 * i + 1, f"x{template} {name}s")]
    got = texts(line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {k: "" if k % 2 else v for k, v in rows}


def test_rounds_within_one_star(spark, tmp_path):
    """Of lines that share one band and are unlike its first, those that share what it lacks meet in later rounds."""
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def made(n):
        return "".join(r.choice(letters) for _ in range(n))

    start, mids = made(60), [made(60) for _ in range(3)]
    lines = [(0, start)] + [(1 + 10 * i + j, f"{start} {mids[i]} {made(50) * (j // 2)}" + "x" * (j % 2)) for i in range(3) for j in range(10)]
    # Texts of a made-up id; even and odd lines of a pair are nearly equal, the others of a middle are not.
    lines = [(k, t if k == 0 else f"{t} {k - (k + 1) % 2}") for k, t in lines]
    df = spark.createDataFrame(lines, "h long, line string")
    bands = df.select("h", F.lit(1).cast("long").alias("band"))
    scratch = line_dedup_module.Scratch(spark, "test")
    got = line_dedup_module.links_of(bands, lambda ends: df.join(ends.distinct(), "h"), scratch)
    links = {(x.a, x.b) for x in got.collect()}

    def sets(t):
        return {t[k : k + 5] for k in range(len(t) - 4)}

    def similar(x, y):
        x, y = sets(x), sets(y)
        return 100 * len(x & y) >= 80 * len(x | y)

    want = {(a, b) for a, x in lines for b, y in lines if a < b and similar(x, y)}
    assert want and links <= want

    def groups(pairs):
        root = {k: k for k, _ in lines}
        for a, b in sorted(pairs):
            ra, rb = root[a], root[b]
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
        return root

    assert groups(links) == groups(want)


def test_no_pair_of_a_band_is_left_out(spark):
    """Lines like a band's first line meet those that aren't, and pairs that have nothing in common with it are found, in small and large bands."""
    r = random.Random(5)

    def made(n):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    def chain(n):
        # Each step is similar to the one before; two steps together are not.
        x = made(100)
        steps = [x]
        for k in range(n - 1):
            x = x[: 6 * k] + made(6) + x[6 * k + 6 :]
            steps.append(x)
        return steps

    bands, lines = [], []
    for band, own in enumerate([chain(3), chain(9), [made(100), *chain(2)], [made(100) for _ in range(6)] + chain(3)]):
        for line in own:
            bands.append((band, len(lines)))
            lines.append((len(lines), line))
    df = spark.createDataFrame(lines, "h long, line string")
    scratch = line_dedup_module.Scratch(spark, "test")
    got = line_dedup_module.links_of(spark.createDataFrame(bands, "band long, h long"), lambda ends: df.join(ends.distinct(), "h"), scratch)
    links = {(x.a, x.b) for x in got.collect()}

    def similar(x, y):
        x, y = ({t[k : k + 5] for k in range(len(t) - 4)} for t in (x, y))
        return 100 * len(x & y) >= 80 * len(x | y)

    want = {(a, b) for a, x in lines for b, y in lines if a < b and similar(x, y)}
    assert len(want) == 13 and links == want


def test_few_pairs_of_a_large_band_are_verified(spark, monkeypatch):
    """Unlike lines that share a passage are ruled out without their texts, and copies of one line are linked by few pairs."""
    r = random.Random(8)

    def made(n):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    passage, copy = made(60), made(200)
    lines = [passage + made(140) for _ in range(300)] + [copy[: 2 * k % 190] + made(4) + copy[2 * k % 190 + 4 :] for k in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    seen, verified = [], line_dedup_module._verified
    monkeypatch.setattr(line_dedup_module, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    scratch = line_dedup_module.Scratch(spark, "test")
    got = line_dedup_module.links_of(df.select(F.lit(1).cast("long").alias("band"), "h"), lambda ends: df.join(ends.distinct(), "h"), scratch)
    links = got.collect()
    assert all(x.a >= 300 and x.b >= 300 for x in links)
    assert {r.component for r in line_dedup_module.connected_components(got, scratch, "t").collect()} == {300}
    assert len(seen) >= 1 and sum(seen) < 2_000


def test_text_of_many_lines(spark):
    """The verdict on a text's lines is linear in their number."""
    text = "\n".join(f"{i * 7919 % 1000003} {i * i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    gone = spark.range(0, 200_000, 2).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("pos"))
    out = line_dedup_module._without(docs, gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))).first().text
    assert out == "\n".join(text.split("\n")[1::2])


def test_odd_rows(spark, docs_kind):
    rows = [
        (1, None, "en", "s", None),
        (2, "", "en", "s", 0),
        (3, "\n \n", "en", "s", 3),
        (4, "ab", "en", "s", 2),
        (5, "ab\nab\nabc", "en", "s", 9),
        (6, "x" * 50_000, "en", "s", 50_000),
        (7, "x" * 60_000, "en", "s", 60_000),
        (None, "ab", "en", "s", 2),
    ]
    df = spark.createDataFrame(rows, docs_kind).withColumns({"h": F.lit(1), "pos": F.lit(2), "line": F.lit("x"), "_gone": F.lit(0), "gone": F.lit(0), "_doc": F.lit(0), "own": F.lit("o"), "key": F.lit("k"), "a.b": F.lit(1)})
    out = line_dedup(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1] == (None, None) and got[2] == ("", 0) and got[3] == ("\n \n", 3) and got[4] == ("ab", 2)
    assert got[5] == ("abc", 3) and got[6] == ("x" * 50_000, 50_000) and got[7] == ("", 0) and got[None] == ("ab", 2)


def test_repeated_rows_and_empty_table(spark, docs_kind):
    rows = [(1, LINE, "en", "s", 1)] * 3
    assert [r.text for r in line_dedup(spark.createDataFrame(rows, docs_kind)).collect()] == [LINE] * 3
    assert line_dedup(spark.createDataFrame([], docs_kind)).collect() == []


def test_stays_in_the_jvm(spark):
    plan = line_dedup(spark.createDataFrame([(1, LINE), (2, LINE)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
