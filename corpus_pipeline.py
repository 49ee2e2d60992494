"""A corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the
columns of ``documents``; the last returns the places of the documents in the token files.
:func:`run` writes each stage's rows to the shared folder and reads them for the next.

Cases that hold for every stage: texts of any length are read whole; an empty table gives an empty
result; extra columns of any names go along as they are, except into the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, langid, mixing, ngram_join, tokenfiles
from tidelog.llm.shared import cut, table

#: Token ids and duplicate groups need code that SQL can't express.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in no known language: null and empty texts too.

    Repeated rows are kept or dropped alike; of two languages with equal scores the first by name wins.
    """
    return langid.identify(docs, carry=True).where("kept").select("row.*")


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id.

    A row without id stays only where its group has no other; ties are broken by hashes of the row, and
    of rows with equal id and text one stays. Rows without words are in no group; all of them stay, once.
    """
    return ngram_join.one_per_component(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item.

    Equal texts go or stay alike; null and empty texts leak nothing, and an empty benchmark drops nothing.
    """
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights.

    A null source is a source of its own; rows with equal id, text and source are one draw; a null text
    has size 0 and may come through any number of times from 0 to 2.
    """
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns where each document lies.

    In ascending order of doc_id, null first; copies of a document follow each other, each with a place
    of its own; a null text is an empty one, of which the end id is all.
    """
    packed = tokenfiles.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources", mixed),
    ("token files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k}")
    return docs
