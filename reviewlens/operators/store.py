"""Stored tables: keyed rows with caps, the contribution store, the cache of review sketches, the queue of contributions, and what is held in all.

A keyed table is small and is rewritten whole; a version is written beside the last
and takes effect by its name, so a reader never sees half of one.  Contributed
edges are many: they are appended by day of arrival, and days are dropped whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.functions import stats
from reviewlens.functions import text as T
from reviewlens.operators import history

# Caps and delays of the queue, and how the sketches of a cached review are built.
QUEUE_CAP, MIN_DELAY_S, MAX_DELAY_S = 20_000, 3_600, 21_600
BUILD = {"shingle_size": 5, "permutations": 128, "dimensions": T.DIMENSIONS}
CLAIM = ["reviewer_hash", "product_hash", "star_rating", "week_bucket", "verified"]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass
class Keyed:
    """A table of rows by key.  newest: the columns by which rows are listed, newest first; cap: how many stay."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    newest: list[str] = field(default_factory=list)
    cap: int | None = None

    def _versions(self) -> list[str]:
        at, fs = _files(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if n.startswith("v="))

    def all(self) -> DataFrame:
        """All rows; none before the first write."""
        versions = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)

    def _replace(self, rows: DataFrame) -> None:
        versions = self._versions()
        number = int(versions[-1][2:]) + 1 if versions else 0
        rows.write.mode("overwrite").parquet(f"{self.path}/_v={number:09d}")
        at, fs = _files(self.spark, f"{self.path}/_v={number:09d}")
        fs.rename(at, _files(self.spark, f"{self.path}/v={number:09d}")[0])
        # the version before stays for those who are reading it
        for old in versions[:-1]:
            fs.delete(_files(self.spark, f"{self.path}/{old}")[0], True)

    def put(self, rows: DataFrame) -> None:
        """Add rows, replacing those with their keys (the last of equal ones by the order of ``newest``), and keep the newest ``cap``."""
        order = [F.col(c).desc() for c in self.newest] or [F.lit(0)]
        own = rows.select(*self.all().columns).withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(*order))).where("_n = 1").drop("_n")
        merged = self.all().join(own.select(self.key), self.key, "left_anti").select(*own.columns).unionByName(own)
        self._replace(merged.orderBy(*order).limit(self.cap) if self.cap else merged)

    def read(self, key) -> DataFrame:
        return self.all().where(F.col(self.key) == F.lit(key))

    def listed(self) -> DataFrame:
        """All rows, newest first."""
        return self.all().orderBy(*[F.col(c).desc() for c in self.newest])

    def count(self) -> int:
        return self.all().count()

    def first(self, column: str):
        """The least value of a column; None for an empty table."""
        return self.all().agg(F.min(column)).first()[0]

    def delete(self, keys: DataFrame) -> None:
        self._replace(self.all().join(keys.select(self.key), self.key, "left_anti").select(*self.all().columns))

    def clear(self) -> None:
        self._replace(self.all().where("false"))


# -- contributed edges --------------------------------------------------------------------


def claim_keys() -> list[Column]:
    """The columns that make a claim; an unknown verification equals another."""
    return [F.col(c) if c != "verified" else F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("verified") for c in CLAIM]


def collapse(edges: DataFrame, order: str = "id") -> DataFrame:
    """The first row of each claim."""
    first = F.row_number().over(Window.partitionBy(*claim_keys()).orderBy(order))
    return edges.withColumn("_n", first).where("_n = 1").drop("_n")


def unclaimed(edges: DataFrame, held: DataFrame) -> DataFrame:
    """``edges`` whose claim isn't held yet, the earliest of each claim."""
    keyed = lambda df: df.withColumn("_v", F.coalesce(F.col("verified").cast("string"), F.lit("-")))
    on = [c for c in CLAIM if c != "verified"] + ["_v"]
    first = F.row_number().over(Window.partitionBy(*on).orderBy("received_at"))
    fresh = keyed(edges).withColumn("_n", first).where("_n = 1").drop("_n")
    return fresh.join(keyed(held).select(*on).distinct(), on, "left_anti").drop("_v").select(*edges.columns)


def list_since(edges: DataFrame, cutoff: Column) -> DataFrame:
    """Edges that arrived at the cutoff or later; by whole days first, so that older days aren't read."""
    own = edges.where(F.col("received_at") >= cutoff)
    return own.where(F.col("day") >= F.to_date(cutoff)) if "day" in edges.columns else own


def prune_older(spark: SparkSession, path: str, cutoff: Column) -> int:
    """Drop the days before the cutoff's day of a table by ``day``; returns how many.  Rows of the day itself go when it has passed."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return 0
    limit = str(spark.range(1).select(F.to_date(cutoff).alias("d")).first()["d"])
    old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("day=") and s.getPath().getName()[4:] < limit]
    for day in old:
        fs.delete(day, True)
    return len(old)


# -- cached reviews ----------------------------------------------------------------------


def cache_key(site: Column, product: Column) -> Column:
    """Hex SHA-256 of site and product."""
    return F.sha2(F.concat_ws(":", site, product), 256)


def sketched(reviews: DataFrame) -> DataFrame:
    """``reviews`` without text: text_signature and text_terms (bucket -> count) instead, null without text, and how they were built."""
    there = F.length("text") > 0
    out = reviews.withColumn("text_signature", F.when(there, T.signature(T.fold_space(F.col("text"))))).withColumn("text_terms", F.when(there, T.hashed_terms(T.terms(F.col("text")))))
    return out.withColumns({k: F.lit(v) for k, v in BUILD.items()}).drop("text")


def cached(cache: DataFrame, now: Column) -> DataFrame:
    """Cached rows that haven't expired and whose sketches this build made."""
    own = F.lit(True)
    for k, v in BUILD.items():
        own = own & (F.col(k) == v)
    return history.unexpired(cache, now).where(own)


def unit_terms(terms: Column, dims: int = T.DIMENSIONS) -> Column:
    """The unit vector of term counts (bucket -> count); null for a zero vector or a bucket out of range."""
    fine = F.forall(F.map_keys(terms), lambda b: (b >= 0) & (b < dims))
    norm = F.sqrt(F.aggregate(F.map_values(terms), F.lit(0.0), lambda s, x: s + x * x))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.coalesce(F.try_element_at(terms, b), F.lit(0)) / norm)
    return F.when(fine & (norm > 0), dense)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two arrays (of unit vectors: their cosine)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# -- the queue ---------------------------------------------------------------------------


def enqueue(queue: DataFrame, edges: DataFrame, now: Column, seed: int = 0, cap: int = QUEUE_CAP) -> DataFrame:
    """``queue`` with as many of ``edges`` (by id) as there is room for; each is ready after one to six hours, drawn by its id."""
    room = max(0, cap - queue.count())
    wait = MIN_DELAY_S + stats.uniform(F.lit(seed), F.col("id")) * (MAX_DELAY_S - MIN_DELAY_S)
    ready = F.timestamp_micros((F.unix_micros(now) + wait * 1_000_000).cast("long"))
    new = edges.orderBy("id").limit(room).withColumn("ready_at", ready)
    return queue.unionByName(new.select(*queue.columns))


def defer(queue: DataFrame, until: Column) -> DataFrame:
    """Nothing leaves before ``until``; nothing is dropped."""
    return queue.withColumn("ready_at", F.greatest("ready_at", until))


def flush(queue: DataFrame, now: Column, size: str = "size", most: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """Due rows in batches by order of readiness, and rows that no batch could ever carry."""
    due = queue.where(F.col("ready_at") <= now)
    sendable = due.where(F.col(size) <= most).withColumn("_all", F.lit(0))
    return history.batches(sendable.withColumn("_o", F.struct("ready_at", "id")).drop("_o"), "_all", "ready_at", size, 500, most).drop("_all"), due.where(F.col(size) > most)


def settle(queue: DataFrame, sent: DataFrame, status: Column, until: Column) -> DataFrame:
    """``queue`` after its batches (sent: id, and what ``status`` needs) were answered: accepted and refused ones go, all others wait until ``until``.

    A refusal is final for 4xx but 408, 425 and 429.
    """
    final = ((status >= 200) & (status < 300)) | ((status >= 400) & (status < 500) & ~status.isin(408, 425, 429))
    done = sent.where(final).select("id")
    held = sent.where(~F.coalesce(final, F.lit(False))).select("id").withColumn("_held", F.lit(True))
    left = queue.join(done, "id", "left_anti").join(held, "id", "left")
    return left.withColumn("ready_at", F.when(F.col("_held"), F.greatest("ready_at", until)).otherwise(F.col("ready_at"))).select(*queue.columns)


# -- what is held --------------------------------------------------------------------------


def holdings(checks: DataFrame, watched: DataFrame, cache: DataFrame, queue: DataFrame) -> DataFrame:
    """checks, watched, cached, oldest_cached, queued and next_due: one row from four aggregates."""
    one = lambda df, *aggs: df.agg(*aggs)
    n = F.count("*")
    return (
        one(checks, n.alias("checks"))
        .crossJoin(one(watched, n.alias("watched")))
        .crossJoin(one(cache, n.alias("cached"), F.min("cached_at").alias("oldest_cached")))
        .crossJoin(one(queue, n.alias("queued"), F.min("ready_at").alias("next_due")))
    )


def counted(n: Column, one: str, many: str) -> Column:
    """A count with its noun, with group separators."""
    return F.when(n.isNotNull(), F.concat_ws(" ", F.format_number(n, 0), F.when(n == 1, one).otherwise(many)))


def ago(then: Column, now: Column) -> Column:
    """today, yesterday or N days ago."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86_400)
    return F.when(days < 1, "today").when(days == 1, "yesterday").otherwise(F.format_string("%d days ago", days))


def holdings_lines(held: DataFrame, now: Column) -> DataFrame:
    """line: what is held, for people."""
    oldest = F.coalesce(F.concat(F.lit(", the oldest of "), ago(F.col("oldest_cached"), now)), F.lit(""))
    minutes = F.round((F.unix_timestamp("next_due") - F.unix_timestamp(now)) / 60)
    due = F.when(minutes <= 0, "now").when(minutes < 60, F.concat(F.lit("in "), counted(minutes, "minute", "minutes"))).otherwise(F.concat(F.lit("in "), counted(F.round(minutes / 60), "hour", "hours")))
    lines = [
        F.concat(F.lit("stored: "), counted(F.col("checks"), "check", "checks")),
        F.concat(F.lit("watched: "), counted(F.col("watched"), "listing", "listings")),
        F.concat(F.lit("cached: "), counted(F.col("cached"), "listing", "listings"), oldest),
        F.concat(F.lit("to be sent: "), counted(F.col("queued"), "row", "rows"), F.coalesce(F.concat(F.lit(", the first "), due), F.lit(""))),
    ]
    return held.select(F.explode(F.array(*lines)).alias("line"))


# -- flagged hashes ------------------------------------------------------------------------


@dataclass
class Flags:
    """Flagged hashes in a table by their first two digits, so that a lookup reads only the parts that it asks for.  Nothing is ever removed."""

    spark: SparkSession
    path: str

    def all(self) -> DataFrame:
        at, fs = _files(self.spark, self.path)
        schema = "reviewer_hash string, part string"
        return self.spark.read.schema(schema).parquet(self.path) if fs.exists(at) else self.spark.createDataFrame([], schema)

    def add(self, hashes: DataFrame) -> None:
        """Add hashes that aren't held yet."""
        keyed = hashes.select("reviewer_hash").distinct().withColumn("part", F.substring("reviewer_hash", 1, 2))
        fresh = keyed.join(self.all(), ["reviewer_hash", "part"], "left_anti").select("reviewer_hash", "part")
        fresh.repartition("part").write.mode("append").partitionBy("part").parquet(self.path)

    def matches(self, prefix: str) -> DataFrame:
        """Flagged hashes that begin with a prefix of two digits or more, sorted."""
        own = self.all().where((F.col("part") == prefix[:2]) & F.col("reviewer_hash").startswith(prefix))
        return own.select("reviewer_hash").orderBy("reviewer_hash")

    def answer(self, prefixes: DataFrame) -> DataFrame:
        """prefix, hashes: for each prefix the flagged hashes that begin with it (none: empty)."""
        asked = prefixes.select("prefix").distinct().withColumn("part", F.substring("prefix", 1, 2))
        hits = asked.join(self.all(), "part", "left").where(F.col("reviewer_hash").isNull() | F.col("reviewer_hash").startswith(F.col("prefix")))
        found = hits.groupBy("prefix").agg(F.sort_array(F.collect_list("reviewer_hash")).alias("hashes"))
        return asked.select("prefix").join(found, "prefix", "left").select("prefix", F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"))
