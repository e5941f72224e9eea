"""Training-corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on what
the stage before it kept; all but the last return the columns of documents.
run() writes each stage's rows as Parquet in the shared folder and reads them
again for the next. Stages that run Python bound the session's Arrow batches by
bytes: executors whose heaps have grown in earlier stages have little room.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, linededup, minhash, packing, quality
from quarry.llm.common import bounded_batches, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents below this probability of label 1 are rejected.
KEEP_QUALITY = 0.3


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier, fitted on the labelled rows, scores under KEEP_QUALITY.

    Row by row: repeated rows and doc_ids are judged alike, each by its own
    text; a null or empty text has the score of an empty one; texts of any
    length are scored as a whole; without rows there are none.
    """
    bounded_batches(spark)
    net = quality.fit_quality(docs, table(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 5 != 0")
    return quality.keep_quality(_columns(docs), net, KEEP_QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that earlier lines match; n_chars follows. A document that loses all its text goes.

    Null and empty texts stay as empty ones, as do documents of short lines
    alone; rows that repeat a doc_id and a text are treated alike; see
    linededup.dedup_lines for ties. Without rows there are none.
    """
    rows = linededup.dedup_lines(_columns(docs), keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return rows.where(~emptied).withColumn("n_chars", n_chars).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest doc_id (five-word shingles, similarity 0.8).

    Texts without words, empty and null ones are in no group and stay. Of a
    doc_id's several texts in one group, and of equal rows, one stays; a null
    doc_id counts as one id below all others. Without rows there are none.
    """
    bounded_batches(spark)
    return minhash.drop_near_duplicates(_columns(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    By each row's own text, so other rows of its doc_id stay; null and empty
    texts hold nothing; equal rows are treated alike. Without rows there are
    none, and without items all stay.
    """
    bounded_batches(spark)
    return decontaminate.drop_contaminated(_columns(docs), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of what is left into sequences of at most 1024.

    A null or empty text is its end id alone; repeated rows are packed as
    documents of their own; texts of any length are cut; without rows there
    are none.
    """
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: A learnt classifier, an embedding and a tokenizer can't be put in SQL; tests/llm/test_pipeline.py holds each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
