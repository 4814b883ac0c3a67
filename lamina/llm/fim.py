"""Fill-in-middle transformation and its inverse in DataFrame functions.

A text becomes the array of its units, two cuts from a hash of doc_id part it
into prefix, middle and suffix, and these are laid out behind sentinels. Units
are runs of BLOCK code points; the two in which a cut falls are opened into
single ones, so that cuts lie between units and a long text has few of them.
The inverse finds the sentinels; a text that holds one itself stays plain, so
each occurs once in an output and the first is always the right one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a unit that no cut falls into.
BLOCK = 64
#: Of 100 texts so many stay plain, and of 100 others so many have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


def _hash(group: int) -> Column:
    """The group-th 8 hex digits of the document's sha256 as an unsigned integer."""
    return F.conv(F.substring("_h", 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output; one row per input row.

    Lengths are in code points and null in plain rows. Null counts as the empty
    text, which stays plain. A null doc_id is hashed as an empty string. Equal
    rows get equal results. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.length("text").cast("long")).withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    one, two = _hash(1) % (F.col("n") + 1), _hash(2) % (F.col("n") + 1)
    marked = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(s))
    form = F.when((F.col("n") == 0) | marked | (_hash(3) % 100 >= 100 - plain), "plain").when(_hash(4) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form).withColumn("_lo", F.least(one, two).cast("int")).withColumn("_hi", F.greatest(one, two).cast("int"))
    rows = rows.withColumn("_w", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    # The blocks of the cuts, from 0, and where the cuts lie among the units.
    rows = rows.withColumn("_i", F.expr(f"_lo div {BLOCK}").cast("int")).withColumn("_j", F.expr(f"_hi div {BLOCK}").cast("int"))
    opened = lambda k: F.coalesce(F.regexp_extract_all(F.get("_w", F.col(k)), F.lit("(?s)."), F.lit(0)), F.array().cast("array<string>"))
    between = F.when(F.col("_j") > F.col("_i"), F.concat(F.slice("_w", F.col("_i") + 2, F.greatest(F.col("_j") - F.col("_i") - 1, F.lit(0))), opened("_j"))).otherwise(F.array().cast("array<string>"))
    units = F.concat(F.slice("_w", F.lit(1), F.col("_i")), opened("_i"), between, F.slice("_w", F.col("_j") + 2, F.size("_w")))
    skipped = F.when(F.col("_j") > F.col("_i"), F.lit(BLOCK - 1)).otherwise(F.lit(0))
    rows = rows.select("*", units.alias("_u"), (F.col("_i") + F.col("_lo") % BLOCK).alias("_a"), (F.col("_j") + skipped + F.col("_hi") % BLOCK).alias("_b"))
    part = lambda start, length: F.array_join(F.slice("_u", start, length), "")
    parts = rows.select("*", part(F.lit(1), F.col("_a")).alias("_p"), part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("_m"), part(F.col("_b") + 1, F.size("_u") - F.col("_b")).alias("_s"))
    p, s, m = (F.array(F.lit(mark), F.col(c)) for mark, c in ((PREFIX, "_p"), (SUFFIX, "_s"), (MIDDLE, "_m")))
    laid = F.when(F.col("form") == "psm", F.array_join(F.flatten(F.array(p, s, m)), "")).when(F.col("form") == "spm", F.array_join(F.flatten(F.array(s, p, m)), ""))
    cut = F.col("form") != "plain"
    return parts.select(
        "doc_id", "n", "form",
        F.when(cut, F.col("_lo").cast("long")).alias("prefix_chars"),
        F.when(cut, (F.col("_hi") - F.col("_lo")).cast("long")).alias("middle_chars"),
        F.coalesce(laid, F.col("text")).alias("output"),
    )


def restore(rows: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """rows with the text that each output was made of, from the output and its form alone.

    Null outputs and forms give null; so does a form other than the three.
    """
    second = F.when(F.col(form) == "psm", SUFFIX).otherwise(PREFIX)
    own = ["_outer", "_inner"]
    while {c.lower() for c in rows.columns} & set(own):
        own = [c + "_" for c in own]
    rows = rows.withColumn(own[0], F.split(F.substr(F.col(output), F.lit(len(PREFIX) + 1)), F.concat(F.lit(r"\Q"), second, F.lit(r"\E")), 2))
    rows = rows.withColumn(own[1], F.split(F.get(own[0], F.lit(1)), F.lit(rf"\Q{MIDDLE}\E"), 2))
    one, two, last = F.get(own[0], F.lit(0)), F.get(own[1], F.lit(0)), F.get(own[1], F.lit(1))
    text = F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(one, last, two)).when(F.col(form) == "spm", F.concat(two, last, one))
    return rows.withColumn(out, text).drop(*own)
