"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
documents. Columns beyond doc_id, text, lang and n_chars pass through, whatever
their names; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.langid import held_out, identify, learn
from lamina.llm.line_dedup import line_dedup
from lamina.llm.ngram_join import ngram_jaccard_join
from lamina.llm.packing import best_fit
from lamina.llm.queries import tokenizer_path
from lamina.llm.shared import Scratch, tidy
from lamina.llm.toxicity import fit, sample, toxicity

#: Least share of a text's letters in its main language.
MAIN_LANGUAGE = 0.4


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, text and, as one column, all columns but the text, so that texts pass through Python once."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))


def _columns(whole: DataFrame, docs: DataFrame) -> DataFrame:
    return whole.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those of which no language has MAIN_LANGUAGE of the letters.

    So null and empty texts go. Repeated rows are judged alike; rows without a
    doc_id are judged like others. If no document has a language, all go.
    """
    model = learn(docs.where(~held_out(5, 0)))
    tidy(spark)
    known = identify(_whole(docs), model, keep=("text", "_row"))
    return _columns(known.where((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_LANGUAGE)), docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic; learns from the labels that aren't held out.

    Null and empty texts get the score of a text without any response, which is
    no toxic one. Repeated rows are judged alike, rows without a doc_id like
    others. Without labels of both classes all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(3, 1))
    model = fit(sample(docs, labels).collect())
    tidy(spark)
    return _columns(toxicity(_whole(docs), model, keep=("text", "_row")).where("predicted = 0"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that nearly repeat one that comes before, and the documents that have no word left by that.

    Of equal documents the one with the smallest doc_id stays. Null, empty and
    blank texts stay as they are, and so do rows without a doc_id. Repeated rows
    of a doc_id are one document: each keeps its first lines.
    """
    had = "had"
    while had in map(str.lower, docs.columns):
        had += "_"
    words = F.coalesce(F.regexp_like("text", F.lit(r"\S")), F.lit(False))
    return line_dedup(docs.withColumn(had, words)).where(words | ~F.col(had)).drop(had)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest doc_id stays.

    Null and empty texts and rows without a doc_id are in no group and stay.
    Repeated rows of a doc_id are one document: they stay or go together.
    """
    others = ngram_jaccard_join(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null and empty texts are one token, the end."""
    return best_fit(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_ngrams),
    ("best_fit_packing", pack),
]

#: Classifiers, MinHash and tokenizers are beyond SQL; the tests hold each stage against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
