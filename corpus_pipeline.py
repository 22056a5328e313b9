"""Five stages that turn raw documents into packed training sequences.

Every stage takes a table with doc_id, text and any other columns and returns the
same columns in the same order, but for the last, which returns pieces.  For all of
them: a null text is a text without words (the quality rules reject it), an empty
table gives an empty table, rows that repeat key and text are treated alike until
near-dedup leaves one of them, a null key is one more key, very long texts are
taken whole, and a column of any name passes through, also one that is named like
a measure of an operator (names that begin with two underscores are helpers').
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.line_dedup import dedup_lines
from reviewlens.llm.near_dedup import keep_first
from reviewlens.llm.packing import pack
from reviewlens.llm.quality import filter_quality
from reviewlens.llm.store import fresh_path
from reviewlens.llm.suffix_dedup import remove_repeats

#: No SQL: the stages after the first work on hashes of shingles, grams and token ids; tests hold them against brute force.
ORACLE_SQL = None

#: Bytes of a repeated passage: 50 words have 285 with 4.7 letters and a blank, as in English; the rest is for short words.
PASSAGE_BYTES = 240


def _with_text(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents' columns; those that a stage left without any text go, n_chars follows the text."""
    removed = F.col("__cp_n_removed")
    rest = cleaned.where((removed == 0) | (F.trim(F.col("text"), F.lit(" \n\t\r")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rest = rest.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that stand in too many documents of a host."""
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of three-line windows that occurred before, in the order of keys.

    Documents of fewer than three lines stay as they are; of rows without a key the
    text's hash decides which is first.
    """
    return _with_text(dedup_lines(docs, prefix="__cp_"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more): that of the smallest key.

    Documents without words stay; of rows with the same key and text one stays.
    """
    return keep_first(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE_BYTES`` bytes or more that occur elsewhere.

    All occurrences go, as they are judged on the stage's input; a character that
    is covered in part goes whole.
    """
    return _with_text(remove_repeats(docs, length=PASSAGE_BYTES, prefix="__cp_"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("suffix-array dedup", suffix_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and reread as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
