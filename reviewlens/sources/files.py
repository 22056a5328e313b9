"""File sources and sinks: labelled examples, word vectors, the packed lexicon and table snapshots."""

from __future__ import annotations

import calendar
import struct
import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = "exampleId string, features map<string,double>, label int, metadata map<string,string>"
LABEL = "fixture string, label int, source string, notes string"
# The lexicon's header and how many snapshots are kept.
LEXICON_MAGIC, LEXICON_HEADER, LEXICON_VERSION = b"LEXI", "<4sHHIfI", 1
SNAPSHOTS = 7


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(EXAMPLE).json(path).where("exampleId IS NOT NULL OR label IS NOT NULL OR features IS NOT NULL")


def save_examples(examples: DataFrame, path: str) -> None:
    """Examples as JSON lines."""
    examples.write.json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of fixtures; raises on broken lines, missing names, labels other than 0 and 1, and repeats."""
    rows = spark.read.schema(LABEL + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path).persist()
    bad = rows.agg(F.count_if(F.col("_broken").isNotNull()).alias("broken"), F.count_if(F.col("fixture").isNull()).alias("unnamed"), F.count_if(F.coalesce(~F.col("label").isin(0, 1), F.lit(True))).alias("illegal")).first().asDict()
    bad["repeated"] = rows.groupBy("fixture").count().where("count > 1").count()
    rows.unpersist()
    if any(bad.values()):
        raise ValueError("label file: " + ", ".join(f"{n} {what}" for what, n in bad.items() if n))
    return rows.drop("_broken")


def read_vectors(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """token, vec, place of a word-vector text file: the first of equal tokens, those that tokenise to themselves, the first ``most``."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), parts.alias("p")).where(F.size("p") > 2)
    rows = rows.select(F.get("p", 0).alias("token"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double")).alias("vec"), "place")
    rows = rows.where(reachable(F.col("token")))
    first = rows.groupBy("token").agg(F.min_by("vec", "place").alias("vec"), F.min("place").alias("place"))
    sizes = [r[0] for r in first.select(F.size("vec")).distinct().collect()]
    if len(sizes) > 1:
        raise ValueError("vectors have different lengths")
    return first.orderBy("place").limit(most) if most else first


def build_lexicon(tokens: list[str], vectors: np.ndarray) -> bytes:
    """A packed lexicon: header, token lines, int8 rows of unit vectors (halves away from zero)."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    top = float(np.abs(unit).max()) if unit.size else 0.0
    scale = top / 127 if top else 1.0
    rows = np.clip(np.sign(unit) * np.floor(np.abs(unit) / scale + 0.5), -127, 127).astype(np.int8)
    names = "\n".join(tokens).encode()
    return struct.pack(LEXICON_HEADER, LEXICON_MAGIC, LEXICON_VERSION, vectors.shape[1], len(tokens), scale, len(names)) + names + rows.tobytes()


def parse_lexicon(data: bytes) -> tuple[list[str], np.ndarray]:
    """Tokens and vectors of a packed lexicon; raises if it is cut or of another kind."""
    size = struct.calcsize(LEXICON_HEADER)
    if len(data) < size:
        raise ValueError("lexicon is cut")
    magic, version, dims, count, scale, n = struct.unpack_from(LEXICON_HEADER, data)
    if magic != LEXICON_MAGIC or version != LEXICON_VERSION or len(data) != size + n + dims * count:
        raise ValueError("not a lexicon of this version")
    tokens = data[size : size + n].decode().split("\n") if count else []
    return tokens, np.frombuffer(data, np.int8, dims * count, size + n).reshape(count, dims).astype(float) * scale


def fit_tokens(sizes: list[int], dims: int, most: int) -> int:
    """How many of the first tokens fit a base64 artifact of ``most`` bytes."""
    total, header = -1, struct.calcsize(LEXICON_HEADER)
    for n, size in enumerate(sizes):
        total += size + 1
        if -(-(header + total + dims * (n + 1)) // 3) * 4 > most:
            return n
    return len(sizes)


def snapshot(table: DataFrame, root: str, now: float | None = None, keep: int = SNAPSHOTS) -> str:
    """Write a table as a dated snapshot (under a temporary name, then renamed) and keep the newest few."""
    sc = table.sparkSession.sparkContext
    name = "snapshot=" + time.strftime("%Y%m%dT%H%M%SZ", time.gmtime(now))
    jpath = sc._jvm.org.apache.hadoop.fs.Path
    fs = jpath(root).getFileSystem(sc._jsc.hadoopConfiguration())
    table.write.mode("overwrite").parquet(f"{root}/_{name}")
    fs.rename(jpath(f"{root}/_{name}"), jpath(f"{root}/{name}"))
    for old in snapshots(table.sparkSession, root)[keep:]:
        fs.delete(jpath(f"{root}/{old}"), True)
    return f"{root}/{name}"


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Names of the snapshots, newest first."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((s.getPath().getName() for s in found if s.getPath().getName().startswith("snapshot=")), reverse=True)


def restore(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot that can be read whole: every row of every column is decoded once."""
    for name in snapshots(spark, root):
        if verify(spark, f"{root}/{name}"):
            return spark.read.parquet(f"{root}/{name}")
    raise FileNotFoundError(f"no readable snapshot in {root}")


def verify(spark: SparkSession, path: str) -> bool:
    """Whether a snapshot's files are complete and can be decoded."""
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JError

    try:
        table = spark.read.parquet(path)
        table.agg(F.sum(F.xxhash64(*table.columns) % 2)).collect()
    except (PySparkException, Py4JError):
        return False
    return True


def snapshot_time(name: str) -> float | None:
    """Seconds since 1970 that a snapshot's name says; None for another name."""
    try:
        return float(calendar.timegm(time.strptime(name, "snapshot=%Y%m%dT%H%M%SZ")))
    except ValueError:
        return None


def snapshot_due(spark: SparkSession, root: str, now: float, every_s: float = 86_400) -> bool:
    """Whether there is no snapshot or the newest is older than ``every_s``."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    names = snapshots(spark, root) if path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path) else []
    times = [t for t in map(snapshot_time, names) if t is not None]
    return not times or now - max(times) >= every_s


def reachable(token: Column) -> Column:
    """Whether a token is one that a text can be cut into: itself, in lower case."""
    return token.rlike(r"^[\p{L}\p{N}]+$") & (F.lower(token) == token)
