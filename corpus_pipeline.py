"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import decontam, jaccard, langid, packing, pii
from lociflow.llm.common import fresh, read, shared_dir, stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The secret of the surrogates; a deployment sets its own.
PII_KEY = "a deployment sets its own secret"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language.

    Null and empty texts and texts without a letter have none, so that they go. Whole texts are read, however long.
    Repeated rows are judged alike; of equally likely languages the first by name counts. Nulls in other columns change
    nothing but that a null lang is not learnt from. An empty table stays empty, and columns stay as they were.
    """
    name = fresh(docs, "language")
    found = langid.identify(docs, TOKENIZER, out=name)
    return found.where(~langid.rejects(F.col(name))).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 or more of 5-word shingles.

    That of the smallest doc_id stays, then of the smallest MD5 of the text; a null doc_id comes last. Rows without words,
    null and empty texts too, stay all; rows that repeat doc_id and text count once. Sets are made of whole texts, however
    long. An empty table stays empty, and columns stay as they were.
    """
    return jaccard.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a benchmark overlap.

    Null and empty texts overlap nothing and stay, as all rows do where the benchmark has no row or no text. Repeated rows
    go or stay together; one overlap of one item is enough. Whole texts are searched, however long. An empty table stays
    empty, and columns stay as they were.
    """
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates.

    No row goes. Null and empty texts stay as they are; equal texts come out equal, and one entity gets one surrogate in all
    documents. Of entities that draw the same, the smaller canonical form keeps the draw. Whole texts are searched, however
    long. An empty table stays empty, and columns other than text stay as they were.
    """
    return pii.surrogate(docs, PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of powers of two; one row per piece with its ids.

    A null or empty text is the end id alone. Repeated rows are packed each. A text of any length becomes pieces of at most
    4,096 tokens. Other columns than doc_id and text are not read; a null doc_id stays null. An empty table gives no row.
    """
    return packing.pack(docs, TOKENIZER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL cannot express the language model of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is stored in the shared folder and read again by the next.

    Nulls, empty and very long texts, ties, repeated rows and further columns are as each stage says; empty ``documents`` give
    no piece.
    """
    docs = read(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
