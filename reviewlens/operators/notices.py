"""Small published things: policy changes, time budgets, counters as text, and a load to test with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.functions import stats

# The time that one analysis may take, and the shape of the test load.
BUDGET_MS = 1500
LOAD_WORDS, LOAD_COPIES, LOAD_DAYS, LOAD_VERIFIED = 40, 0.2, 365, 0.7


def pending_changes(changes: DataFrame, acknowledged: int) -> DataFrame:
    """Policy changes (version, effective_at, summary) that a reader hasn't acknowledged, in order."""
    return changes.where(F.col("version") > acknowledged).orderBy("version")


def change_problems(changes: DataFrame) -> DataFrame:
    """place, problem: versions that don't rise by the order of ``place``, dates that go back, and empty summaries."""
    w = Window.orderBy("place")
    rows = changes.withColumns({"_v": F.lag("version").over(w), "_t": F.lag("effective_at").over(w)})
    said = F.array_compact(
        F.array(
            F.when((F.col("version") < 1) | (F.col("version") <= F.coalesce("_v", F.lit(0))), "the version doesn't rise"),
            F.when(F.col("effective_at") < F.col("_t"), "it takes effect before the one before it"),
            F.when(F.trim("summary") == "", "it says nothing"),
        )
    )
    return rows.select("place", F.explode(said).alias("problem"))


def headline(changes: DataFrame, now: Column) -> DataFrame:
    """headline: whether something will change or has changed; null without changes."""
    return changes.agg(F.when(F.count("*") == 0, F.lit(None)).when(F.count_if(F.col("effective_at") > now) > 0, "the policy will change").otherwise("the policy has changed").alias("headline"))


def time_verdict(durations: DataFrame, budget_ms: float = BUDGET_MS) -> DataFrame:
    """label, median_ms, worst_ms, within_budget and headroom_ms of measured durations (label, ms)."""
    per = durations.groupBy("label").agg(F.median("ms").alias("median_ms"), F.max("ms").alias("worst_ms"))
    return per.withColumns({"within_budget": F.col("median_ms") < budget_ms, "headroom_ms": budget_ms - F.col("median_ms")})


def metrics_text(samples: DataFrame) -> DataFrame:
    """line: samples (name, kind, help, labels: map, value) in the exposition format, a help and a type line before each name's samples."""
    label = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))), ",")
    own = F.when(F.size("labels") > 0, F.concat(F.lit("{"), label, F.lit("}"))).otherwise("")
    rows = samples.select("name", F.lit(2).alias("part"), own.alias("k"), F.concat("name", own, F.lit(" "), F.col("value").cast("string")).alias("line"))
    heads = samples.groupBy("name").agg(F.min("help").alias("help"), F.min("kind").alias("kind"))
    helps = heads.select("name", F.lit(0).alias("part"), F.lit("").alias("k"), F.concat_ws(" ", F.lit("# HELP"), "name", "help").alias("line"))
    kinds = heads.select("name", F.lit(1).alias("part"), F.lit("").alias("k"), F.concat_ws(" ", F.lit("# TYPE"), "name", "kind").alias("line"))
    return helps.union(kinds).union(rows).orderBy("name", "part", "k").select("line")


def synthetic_reviews(spark: SparkSession, n: int, listings: int = 1, seed: int = 42) -> DataFrame:
    """``n`` made-up reviews of each listing: forty words, a fifth of them copies of an earlier text, over a year; the same for the same seed."""
    rows = spark.range(n * listings).select((F.col("id") % listings).alias("listing_id"), F.floor(F.col("id") / listings).alias("review_id"))
    draw = lambda what, *more: stats.uniform(F.lit(seed), F.lit(what), F.col("listing_id"), *(more or (F.col("review_id"),)))
    source = F.when((draw("copy") < LOAD_COPIES) & (F.col("review_id") > 0), F.floor(draw("of") * F.col("review_id"))).otherwise(F.col("review_id"))
    rows = rows.withColumn("_text", source.cast("long"))
    words = F.transform(F.sequence(F.lit(1), F.lit(LOAD_WORDS)), lambda i: F.concat(F.lit("w"), F.floor(draw("word", F.col("_text"), i) * 500).cast("string")))
    return rows.select(
        "listing_id",
        "review_id",
        (1 + F.floor(draw("rating") * 5)).cast("double").alias("rating"),
        F.array_join(words, " ").alias("text"),
        F.date_add(F.lit("2025-01-01").cast("date"), F.floor(draw("day") * LOAD_DAYS).cast("int")).alias("review_date"),
        F.lit(None).cast("string").alias("date_precision"),
        (draw("verified") < LOAD_VERIFIED).alias("verified"),
        F.concat(F.lit("u"), F.floor(draw("who") * n).cast("string")).alias("reviewer_id"),
    )
