"""Line dedup by overlapping three-line windows.

Lines are what ``\\n`` separates, compared exactly.  Every window of three
consecutive lines is hashed to 128 bits; windows that occur at more than one
place are found by one pre-aggregated grouping; every occurrence but the first,
in the order (key, digest of the text, position), marks its three lines, and the
marked lines (overlaps merged) are removed.

Rows with the same key and the same text are one document: each gets the same
result.  A null key sorts first; a null text has no lines and stays null; texts of
fewer than three lines stay as they are.  Other columns pass through; helper
columns are named with a leading ``__ld_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.flat import pieces
from reviewlens.llm.store import drop, written

WINDOW = 3


def identity(df: DataFrame, text: str, key: str, prefix: str) -> DataFrame:
    """``df`` with the columns that tell its documents apart: key and 128 bits of the text."""
    return df.select("*", F.col(key).alias(f"{prefix}k"), F.xxhash64(F.col(text)).alias(f"{prefix}a"), F.xxhash64(F.lit(1), F.col(text)).alias(f"{prefix}b"))


def repeated_starts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """__ld_k, __ld_a, __ld_b, starts array<int>: windows of a document that repeat an earlier one."""
    lines = F.split(F.col(text), "\n", -1)
    base = identity(docs, text, key, "__ld_").where(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) >= WINDOW - 1)
    base = base.select("__ld_k", "__ld_a", "__ld_b", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("x"), F.xxhash64(F.lit(2), x).alias("y"))).alias("h"))
    shifted = [F.slice("h", i + 1, F.size("h")).alias(f"l{i}") for i in range(WINDOW)]
    rows = base.select("__ld_k", "__ld_a", "__ld_b", F.arrays_zip(*shifted).alias("w"))
    rows = rows.select("__ld_k", "__ld_a", "__ld_b", F.posexplode("w").alias("pos", "w")).where(F.col(f"w.l{WINDOW - 1}").isNotNull())
    rows = written(
        rows.select(
            "__ld_k", "__ld_a", "__ld_b", "pos",
            F.xxhash64(*[F.col(f"w.l{i}.x") for i in range(WINDOW)]).alias("w1"),
            F.xxhash64(F.lit(3), *[F.col(f"w.l{i}.y") for i in range(WINDOW)]).alias("w2"),
        ),
        "line-windows",
    )
    place = F.struct("__ld_k", "__ld_a", "__ld_b", "pos")
    repeated = rows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("NOT (first <=> last)")
    repeated = written(repeated.drop("last"), "line-repeats")
    later = rows.join(repeated.hint("merge"), ["w1", "w2"]).where(~F.struct("__ld_k", "__ld_a", "__ld_b", "pos").eqNullSafe(F.col("first")))
    starts = written(later.groupBy("__ld_k", "__ld_a", "__ld_b").agg(F.collect_set("pos").alias("starts")), "line-starts")
    drop(rows, repeated)
    return starts


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, plus n_lines and n_removed (long).

    A document that loses every line keeps its row with an empty text.  The new
    columns' names begin with ``prefix``; a column of ``docs`` that has the name of
    one of them gives way to it.
    """
    new_names = [prefix + c for c in ("n_lines", "n_removed")]
    spark_type = docs.schema[text].dataType
    starts = repeated_starts(docs, text, key).select(F.col("__ld_k").alias("__ld_rk"), F.col("__ld_a").alias("__ld_ra"), F.col("__ld_b").alias("__ld_rb"), F.col("starts").alias("__ld_starts"))
    left = identity(docs, text, key, "__ld_")
    # a merge join at every size: the starts grow with the corpus, and small inputs shall behave like large ones
    joined = left.join(starts.hint("merge"), F.col("__ld_k").eqNullSafe(F.col("__ld_rk")) & (F.col("__ld_a") == F.col("__ld_ra")) & (F.col("__ld_b") == F.col("__ld_rb")), "left")
    columns = [c for c in docs.columns if c.lower() not in {x.lower() for x in new_names}]
    joined = joined.select(*[F.col(f"`{c}`") for c in columns], "__ld_starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts, marks = batch.column(text).to_pylist(), batch.column("__ld_starts")
            n_lines, n_removed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, value in enumerate(texts):
                if value is None:
                    continue
                n_lines[i] = value.count("\n") + 1
                if not marks[i].is_valid:
                    continue
                at = np.asarray(marks[i].values)
                gone = np.zeros(n_lines[i], np.bool_)
                for k in range(WINDOW):
                    gone[at + k] = True
                n_removed[i] = gone.sum()
                texts[i] = "\n".join(line for line, out in zip(value.split("\n"), gone.tolist(), strict=True) if not out)
            arrays = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines), pa.array(n_removed)], names=[*columns, *new_names])

    schema = T.StructType([*(T.StructField(c, spark_type if c == text else docs.schema[c].dataType) for c in columns), *(T.StructField(c, T.LongType()) for c in new_names)])
    return joined.mapInArrow(run, schema)
