"""Line dedup: near-duplicate lines of a corpus by MinHash, in DataFrame operations alone.

A line's signature is the smallest hashes of its 12-character shingles (bottom-k
MinHash). They start where words do, and at every character of other scripts than
Latin. Lines with few such places are also signed by the shingles at all places,
and short lines by those of 5 characters.
Two neighbouring minima make a band. Lines that share a band are candidates, and
are verified by the exact Jaccard similarity of their 5-character shingles. Within
a band no pair is left out: the lines of a small band are all compared; in a large
one each is compared with up to three pivots (stars), and then with all lines that
links don't connect it to by then, the closest of two components first. So copies
of one line need few pairs.

Each line has parities: for each of 1,024 slots, whether an odd number of its
shingles fall into it. Those of two sets differ in no more slots than the sets in
shingles, so they rule out most pairs within the join, without the texts and
without losing any that is similar. What they let through is verified.

Distributed union-find merges the verified links. Of each component, the line
that comes first in the corpus stays. Equal lines are one node from the start,
by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, connected_components, join_by_key, tidy

THRESHOLD = 80  # per cent
#: Characters of a signature's shingles, and its minima; a band for any two neighbours.
WIDE, MINIMA = 12, 8
#: Lines of at most so many characters are also signed by shingles of SHINGLE characters.
SHORT = 64
#: A line has few such places if it has fewer than MANY, or more characters for each than SPARSE.
MANY, SPARSE = 8, 16
#: Characters of the shingles that similarity is defined on.
SHINGLE = 5
#: Lines of a band up to which all of them are compared at once.
FEW = 4
#: Words of 64 slots of a line's parities.
WORDS = 16
#: Lines of a band, about, that are compared in one cell.
BLOCK = 1024
#: Slots of the bitmaps that keep lines without a part in the join out of it; 1 MB at most, whatever the input.
SLOTS = 1 << 22


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, h) of the lines that hold more than spaces."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.trim("line") != "").withColumn("h", F.xxhash64("line"))


def _at_every(text, width: int) -> Column:
    """The shingles at every character; a shorter text is one shingle."""
    return F.when(F.char_length(text) < width, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1)))


def _at_starts(text) -> Column:
    """The wide shingles at the start and behind each run of ASCII that isn't a-z, and each character beyond Latin-1; none of a shorter text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{WIDE}}}))[a-z\xdf-\xff]*+(?:[\x00-\x60\x7b-\xbf]++|.|$)"), F.lit(1))


def _lowest(shingles: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.transform(shingles, lambda s: F.hash(s)))), 1, MINIMA)


def _bound(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _neighbours(low: Column, kind: int) -> Column:
    """Band keys of minima: neighbours hashed together, or the only one."""
    both = F.zip_with(low, F.slice(low, 2, MINIMA), lambda a, b: F.xxhash64(a, b, F.lit(kind)))
    return F.slice(both, 1, F.greatest(F.size(low) - 1, F.least(F.size(low), F.lit(1))))


def _bands(line) -> Column:
    """Band keys of a line, by all the signatures that it has."""
    n, none = F.char_length(line), F.array().cast("array<bigint>")

    def signed(starts: Column) -> Column:
        sparse = (F.size(starts) < MANY) | (F.size(starts) * SPARSE < n)
        more = F.when(n <= SHORT, _bound(_lowest(_at_every(line, SHINGLE)), lambda x: _neighbours(x, SHINGLE))).when(sparse, _bound(_lowest(_at_every(line, WIDE)), lambda x: _neighbours(x, 1))).otherwise(none)
        return F.concat(_bound(_lowest(starts), lambda x: _neighbours(x, 0)), more)

    return _bound(_at_starts(line), signed)


def _bits(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of the ids' slots as words of 64; SLOTS / 64 rows at most."""
    slot = F.pmod(F.col(column), F.lit(SLOTS))
    return ids.groupBy((slot / 64).cast("int").alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")).alias("_bits"))


def _let(key: str) -> Column:
    """Whether the bitmap's words let a key through."""
    return F.expr(f"(shiftright(_bits, cast(pmod({key}, 64) as int)) & 1) = 1")


def _word(key: str) -> Column:
    return (F.pmod(F.col(key), F.lit(SLOTS)) / 64).cast("int")


def _within(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose h may be among the bitmap's ids: all that are, and a few others."""
    return rows.withColumn("_word", _word("h")).join(F.broadcast(bits), "_word").where(_let("h")).drop("_word", "_bits")


def _set(line: str) -> Column:
    """The hashes of the shingles that similarity is defined on."""
    return F.array_distinct(F.transform(_at_every(F.col(line), SHINGLE), lambda s: F.xxhash64(s)))


def _signs(text: DataFrame) -> DataFrame:
    """(h, n, p0, p1, ...) of lines (h, line): the size of a line's set, and for each of its slots the parity of the shingles there."""
    each = text.select("h", F.explode(_set("line")).alias("s"))
    word = F.shiftright("s", 6).bitwiseAND(F.lit(WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(s & 63 as int))")
    return each.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("n"), *(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(WORDS)))


def _signed(rows: DataFrame, signs: DataFrame, key: str) -> DataFrame:
    """rows with the signs of the lines in column key, under names with that key behind."""
    return rows.join(signs.select(F.col("h").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in signs.columns if c != "h")), key)


def _far(a: str, b: str) -> Column:
    """Slots in which the parities of lines a and b differ."""
    return sum((F.bit_count(F.col(f"p{k}_{a}").bitwiseXOR(F.col(f"p{k}_{b}"))) for k in range(WORDS)), F.lit(0))


def _may_link(threshold: int, a: str, b: str) -> Column:
    """Whether sizes and parities allow lines a and b to be similar; no similar pair is ruled out.

    Parities differ in at most as many slots as the sets in shingles, and similar
    sets differ in few.
    """
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (F.lit(100) * F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)) & (F.lit(100 + threshold) * _far(a, b) <= F.lit(100 - threshold) * (n + m))


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): all pairs of the lines of bands (band, h, lo, hi, any, rows) of at most FEW, and each line of a larger one with its pivots."""
    few = members.where(F.col("rows") <= FEW)
    few = few.select("band", F.col("h").alias("a")).join(few.select("band", F.col("h").alias("b")), "band").where("a < b").select("a", "b")
    large = members.where(F.col("rows") > FEW).select("h", F.explode(F.array("lo", "hi", "any")).alias("p")).where("h <> p")
    return few.unionByName(large.select(F.least("h", "p").alias("a"), F.greatest("h", "p").alias("b"))).distinct()


def _verified(pairs: DataFrame, text: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose lines are similar."""
    x, y = (text.select(F.col("h").alias(k), F.col("line").alias(v)) for k, v in ("ax", "by"))

    def similar(s: Column) -> Column:
        common = F.size(F.array_intersect(s["x"], s["y"]))
        return _bound(common, lambda c: F.lit(100) * c >= F.lit(threshold) * (F.size(s["x"]) + F.size(s["y"]) - c))

    return pairs.join(x, "a").join(y, "b").where(_bound(F.struct(_set("x").alias("x"), _set("y").alias("y")), similar)).select("a", "b")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (lo, h, component, rows) of the large bands that hold lines of two components, by labels (node, component); bands of one first line are taken together."""
    large = members.where(F.col("rows") > FEW).select("lo", "h").distinct().join(labels.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    group = Window.partitionBy("lo")
    large = large.select("*", F.min("component").over(group).alias("least"), F.max("component").over(group).alias("most"), F.count(F.lit(1)).over(group).alias("rows"))
    return large.where("least < most").drop("least", "most")


def _unlinked(rows: DataFrame, signs: DataFrame, threshold: int) -> DataFrame:
    """(a, b, far, u, v) of the lines of different components u and v in one group (lo, h, component, rows) that signs let through, in cells of bounded size."""
    cut = _signed(rows.withColumn("chunks", F.ceil(F.col("rows") / BLOCK).cast("int")).withColumnRenamed("h", "x"), signs, "x")
    cut = cut.withColumn("i", F.pmod(F.xxhash64("x", F.lit(7)), F.col("chunks")).cast("int"))
    left = cut.withColumn("j", F.explode(F.sequence("i", F.col("chunks") - 1))).drop("rows", "chunks")
    right = cut.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), "j"))).drop("rows", "chunks")
    right = right.select("lo", "i", "j", *(F.col(c).alias("y" if c == "x" else c.removesuffix("_x") + "_y") for c in right.columns if c not in ("lo", "i", "j")))
    both = left.join(right, ["lo", "i", "j"]).where((F.col("component") != F.col("component_y")) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & _may_link(threshold, "x", "y"))
    own = (f(*c).alias(k) for f, c, k in ((F.least, "xy", "a"), (F.greatest, "xy", "b"), (F.least, ("component", "component_y"), "u"), (F.greatest, ("component", "component_y"), "v")))
    return both.select(*own, _far("x", "y").alias("far")).distinct()


def _still_apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, u, v) whose components u and v aren't one by labels (node, component)."""
    for k in "uv":
        pairs = pairs.join(labels.select(F.col("node").alias(k), F.col("component").alias(f"now_{k}")), k, "left")
    return pairs.where(F.coalesce("now_u", "u") != F.coalesce("now_v", "v")).select("a", "b")


def _linked(bands: DataFrame, text_of, scratch: Scratch, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Links (a, b) of pivots and small bands, the components that they make, and the links of what they leave apart, if there are any."""
    band = Window.partitionBy("band")
    members = bands.select("band", "h", F.min("h").over(band).alias("lo"), F.max("h").over(band).alias("hi"), F.min_by("h", F.xxhash64("h")).over(band).alias("any"), F.count(F.lit(1)).over(band).alias("rows"))
    members = scratch.write(members.where("lo < hi"), "members")
    text = scratch.write(text_of(members.select("h")).select("h", "line"), "text")
    tidy(scratch.spark)
    signs = scratch.write(_signs(text), "signs")
    near = scratch.write(_signed(_signed(_stars(members), signs, "a"), signs, "b").where(_may_link(threshold, "a", "b")).select("a", "b"), "near")
    links = scratch.write(_verified(near, text, threshold), "links")
    labels = scratch.write(connected_components(links, scratch, "cc"), "labels")
    rest = scratch.write(_apart(members, labels), "apart")
    scratch.drop("members", "near")
    tidy(scratch.spark)
    if rest.isEmpty():
        return links, labels, None
    more = scratch.write(_unlinked(rest, signs, threshold), "unlinked")
    # Of two components the closest lines first: if these link, no other pair of both is needed.
    closest = more.groupBy("u", "v").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")
    joined = scratch.write(_verified(closest, text, threshold), "closest")
    labels = scratch.write(connected_components(joined.unionByName(_edges(labels)), scratch, "cc-closest"), "joined")
    more = scratch.write(_verified(_still_apart(more, labels), text, threshold), "more")
    scratch.drop("apart", "unlinked", "text", "signs")
    tidy(scratch.spark)
    return links.unionByName(joined), labels, more


def _edges(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("component").alias("a"), F.col("node").alias("b"))


def links_of(bands: DataFrame, text_of, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of the verified links among lines that share bands (band, h); text_of gives the lines (h, line) of ids.

    Similar lines that share a band are linked, or connected by links.
    """
    links, _, more = _linked(bands, text_of, scratch, threshold)
    return links if more is None else links.unionByName(more)


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, pos) of the lines to remove, pos from 0."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    # Every line's hash and place, kept so that the text isn't split again for the verdicts.
    seen = scratch.write(_lines(docs).select("h", "doc_id", "pos", _bands(F.col("line")).alias("bands")), "seen")

    def text_of(ends: DataFrame) -> DataFrame:
        return _within(_lines(docs).select("h", "line"), _bits(ends, "h")).groupBy("h").agg(F.first("line").alias("line"))

    nodes = seen.groupBy("h").agg(F.first("bands").alias("bands"))
    _, labels, more = _linked(nodes.select("h", F.explode("bands").alias("band")), text_of, scratch, threshold)
    if more is not None and not more.isEmpty():
        labels = scratch.write(connected_components(more.unionByName(_edges(labels)), scratch, "all"), "all")

    # The lines that stand several times or in a component, and the one of each that stays.
    group = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(labels.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or component is not null")
    group = scratch.write(group.select("h", F.coalesce("component", "h").alias("component")), "group")
    every = scratch.write(_within(seen.select("h", "doc_id", "pos"), _bits(group, "h")).join(group, "h").drop("h"), "every")
    stay = scratch.write(every.groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("stay"), F.count(F.lit(1)).alias("rows")), "stay")
    gone = scratch.write(join_by_key(every, stay, "component", "rows").where("not (doc_id = stay.doc_id and pos = stay.pos)").select("doc_id", "pos"), "gone")
    scratch.drop_but("gone")
    tidy(scratch.spark)
    return gone


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without their near-duplicate lines; all other columns as they are, but n_chars is counted anew.

    Lines are what line feeds separate. Two lines link if the Jaccard similarity
    of their sets of 5-character shingles is threshold per cent or more (a
    shorter line is one shingle), as far as they share a band. Of a component
    the first line by (doc_id, position) stays. Lines of nothing but spaces are never removed.
    Texts that are null stay null, empty texts stay empty; a text of which every
    line goes is empty. Rows without a doc_id stay as they are. Rows that share
    a doc_id lose lines by position, so each keeps what is first in any of them.
    """
    gone = removed_lines(docs, threshold).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    return _without(docs, gone)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    # All of a row in one column, so that no name of its own clashes.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").cast("long").alias("key"))
    # A document that keeps all its lines needs no shuffle.
    bits = F.broadcast(_bits(gone, "doc_id"))
    placed = whole.withColumn("_word", _word("key")).join(bits, "_word", "left").withColumn("_in", F.coalesce(_let("key"), F.lit(False)))
    both = placed.where("_in").join(gone.select(F.col("doc_id").alias("key"), "gone"), "key", "left").select("own", "gone")
    both = both.unionByName(placed.where("not _in").select("own", F.lit(None).cast("array<int>").alias("gone")))

    def kept(lines: Column) -> Column:
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(_bound(F.split("own.text", "\n"), kept))
    both = both.withColumn("text", text)
    out = [F.col("text") if c == "text" else F.col(f"own.`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        n = F.when(F.col("gone").isNull(), F.col("own.n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
        out = [n.alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, out, strict=True)]
    return both.select(out)
