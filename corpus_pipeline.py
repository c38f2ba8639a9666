"""Training corpus pipeline over `documents`: language ID, line dedup, near-duplicate removal, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared folder and
read again as the next stage's docs. All but the last return the columns of documents.

Null ids and repeated ids are kept apart by their texts and judged by them; a repeat of a row that stays stays too. A null
or empty text is rejected by the language stage; later stages would keep it, but for the line stage's rule below. Ties
go to the smallest id. An empty table gives an empty result. Extra columns are carried up to the last stage whatever
their names: where an operator adds columns of its own, all that it does not read are set aside under reserved names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import bpe, chosen_path, decontam, langid, line_chunks
from mosaiq.llm.common import discard, materialize, read_table

#: Texts of 100 characters or more go if they are below both. The margin alone took 408 clean texts of 51,282 in a table of
#: 0.1 GB (0.8 %). Likeness of clean texts of 300 characters or more was 0.53 at least and 0.62 or more for 99.9 %; of 400
#: texts of random letters of four kinds it was 0.60 at most.
LEAST_MARGIN, LEAST_LIKENESS = 0.4, 0.62


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but those used under a reserved name, and a function that gives all names back."""
    names = {c: c if c in used else f"__carried_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(docs[c].alias(n) for c, n in names.items())), lambda df: df.select(*(df[n].alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that look like no family of the learned languages, go."""
    model = langid.train(docs)
    if model is None:  # no labels to learn from
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    aside, back = set_aside(docs, "text")
    known = langid.predict(aside, model, least_margin=LEAST_MARGIN, least_likeness=LEAST_LIKENESS).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return back(known)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line chunks go from the texts; a document of which nothing is left goes too. n_chars follows the text."""
    aside, back = set_aside(docs, "doc_id", "text")
    left = back(line_chunks.dedup(aside).filter((F.col("lines_removed") == 0) | (F.trim("text") != "")))
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return chosen_path.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.remove(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the checksums of the ids and of the decoded text."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: SQL cannot express the trained classifier, the rolling-hash chunks or the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(docs)
        docs = done
    return docs
