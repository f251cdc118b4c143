"""The corpus pipeline: from ``documents`` to packed sequences, every stage written and read again.

Quality rules drop documents, the Jaccard join keeps one document of each group, substring dedup cuts passages that an
earlier document has, mixing takes documents as often as their source's target wants, packing cuts them into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens.llm import compact_windows, jaccard, mixing, packing, repetition
from venuelens.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. A null or empty text fails; repeated rows are judged one by one; no rows give none."""
    return repetition.kept_documents(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that of the smallest id, then of the smallest text hash.

    Rows go, not ids; of equal rows one stays. A row without a word or with a null id is like no other and stays. No rows give none.
    """
    return jaccard.kept_documents(docs.select(COLUMNS)).select(COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; emptied documents go.

    A null id or text stays as it is; rows of one id are one document, and all of them lose the passages found in one; no rows give none.
    """
    docs = docs.select(COLUMNS)
    found = compact_windows.repeated_passages(docs)
    return with_length(compact_windows.cut_passages(docs, found))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them.

    A null source is a source of its own, last in order; documents without a word are not taken; repeated rows are taken each for
    itself; ties in the shuffled order are broken by id, size and text hash; no rows give none.
    """
    docs = docs.select(COLUMNS)
    placed, pieces = mixing.mix(docs)
    return with_length(mixing.mixed_documents(docs, placed, pieces))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences. A null text is empty (its end mark alone); rows of one id are packed each for itself; no
    rows give none."""
    return packing.pack(docs)


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages),
          ("mixing", mixture), ("packing", packed)]
#: No SQL states token packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage but the last is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
