"""The training-data pipeline over `documents`.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works on everything its
predecessor kept, and its result is written as Parquet and read again as the next one's docs.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import Scratch, scope, table
from paperloom.llm.decontaminate import clean
from paperloom.llm.exact_dedup import drop_exact
from paperloom.llm.packing import pack
from paperloom.llm.quality import keep_good, train
from paperloom.llm.queries import BYTE_BPE, vocabulary
from paperloom.llm.simhash import drop_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier of operator 9 gives a score of 0.5 or more.

    A null text counts as empty and is scored as any other; repeated rows stay or go together; an
    empty table stays empty, and without labels everything is kept.
    """
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts (operator 2).

    A null text equals an empty one, a null id is the smallest; of repeated rows one stays; an empty
    table stays empty.
    """
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near copies (operator 4): five-word shingles, similarity 0.8.

    A null text counts as empty, texts without words are one group, a null id counts last; of
    repeated rows one stays; an empty table stays empty.
    """
    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (operator 7).

    A null or empty text holds none; repeated rows stay or go together; an empty table, or an empty
    benchmark, drops nothing.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences (operator 3).

    A null or empty text is its end id alone; repeated rows are packed each; an empty table gives no
    sequence.
    """
    return pack(docs, vocabulary(BYTE_BPE), "spaces", end_id=0, length=1024)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage wrote for itself goes when its result is written, and so does what it read."""
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scope(spark):
            after = work.save(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(docs)
        docs = after
    return docs
