"""Stored checks: merging, grouping, figures, eviction, import and export, watch changes, paging and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions import stats
from reviewlens.functions import text as T

HISTORY_CAP, WATCH_CAP = 500, 50
CACHE_DAYS = 7
# How much movement of a watched listing is told.
RATING_STEP, REVIEW_SHARE, REVIEW_FLOOR, BURST_STEP, DRIFT_AT, SLACK = 0.2, 0.25, 50, 0.1, 0.5, 1e-9


def review_identity() -> Column:
    """Key of a review: reviewer and date, or its text where one of them is missing."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    whole = F.col("reviewer_id").isNotNull() & F.col("review_date").isNotNull()
    return F.when(whole, F.concat_ws("|", F.lit("id"), plain("reviewer_id"), plain("review_date"))).otherwise(F.concat_ws("|", F.lit("body"), plain("rating"), plain("text")))


def merge_reviews(existing: DataFrame, fetched: DataFrame, group: str = "listing_id", place: str = "review_id") -> DataFrame:
    """All of ``existing`` and those of ``fetched`` whose key is new, the first of equals."""
    key = F.sha2(review_identity(), 256)
    old = existing.withColumn("_k", key)
    first = F.row_number().over(Window.partitionBy(group, "_k").orderBy(place))
    new = fetched.withColumn("_k", key).withColumn("_n", first).where("_n = 1").drop("_n")
    fresh = new.join(old.select(group, "_k").distinct(), [group, "_k"], "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def grouped(entries: DataFrame) -> DataFrame:
    """Newest entry of each product with n; entries without a product stand alone."""
    key = F.coalesce(F.concat(F.lit("p"), F.col("product_key")), F.concat(F.lit("i"), F.col("id").cast("string")))
    w = Window.partitionBy("_k")
    out = entries.withColumn("_k", key).withColumn("_r", F.row_number().over(w.orderBy(F.col("at").desc(), F.col("id").desc()))).withColumn("n", F.count("*").over(w))
    return out.where("_r = 1").drop("_k", "_r")


def newest(entries: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The newest ``cap`` entries: a top-k, not a numbering of the whole table in one task."""
    return entries.orderBy(F.col("at").desc(), F.col("id").desc()).limit(cap)


def search(entries: DataFrame, text: str = "", band: str | None = None) -> DataFrame:
    """Entries whose title holds the text in any case, of a band if one is named."""
    out = entries.where(F.lower("title").contains(text.lower())) if text else entries
    return out.where(F.col("band") == band) if band else out


def ordered(entries: DataFrame, by: str = "newest") -> DataFrame:
    """Sorted by newest, oldest, gap (largest first, unknown last) or title."""
    orders = {"newest": [F.col("at").desc(), F.col("id").desc()], "oldest": [F.col("at"), F.col("id")], "gap": [F.coalesce(F.abs(F.col("claimed") - F.col("adjusted")), F.lit(-1.0)).desc(), F.col("id")], "title": [F.lower("title"), F.col("id")]}
    return entries.orderBy(*orders[by])


def figures(entries: DataFrame) -> DataFrame:
    """checks, listings, mean_gap (over listings' newest entries) and doubtful_share."""
    last = grouped(entries)
    bad = F.col("band").isin("doubtful", "heavily-manipulated")
    return last.agg(F.sum("n").alias("checks"), F.count("*").alias("listings"), F.avg(F.abs(F.col("claimed") - F.col("adjusted"))).alias("mean_gap"), (F.count_if(bad) / F.count("*")).alias("doubtful_share"))


def csv_lines(entries: DataFrame) -> DataFrame:
    """id, line: five CSV columns with formulas disarmed."""
    fields = [F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.col("title"), F.col("band"), F.col("claimed").cast("string"), F.col("adjusted").cast("string")]
    return entries.select("id", F.concat_ws(",", *[T.csv_field(F.coalesce(f, F.lit(""))) for f in fields]).alias("line"))


def import_entries(existing: DataFrame, incoming: DataFrame, cap: int = HISTORY_CAP) -> tuple[DataFrame, DataFrame]:
    """Merged entries (the newest ``cap``), and counts: added, duplicates, rejected, skipped."""
    valid = F.col("at").isNotNull() & F.col("title").isNotNull() & F.col("band").isin(*stats.BANDS)
    identity = F.sha2(F.concat_ws("|", F.col("at").cast("string"), F.coalesce("product_key", F.lit("null")), "title"), 256)
    old = existing.withColumn("_k", identity)
    checked = incoming.withColumn("_ok", F.coalesce(valid, F.lit(False))).withColumn("_k", identity)
    first = F.row_number().over(Window.partitionBy("_k").orderBy("id"))
    good = checked.where("_ok").withColumn("_n", first).join(old.select("_k").distinct().withColumn("_old", F.lit(True)), "_k", "left")
    fresh = good.where("_n = 1 AND _old IS NULL")
    merged = newest(existing.unionByName(fresh.select(*existing.columns)), cap)
    counts = checked.agg(F.count_if(~F.col("_ok")).alias("rejected")).crossJoin(good.agg(F.count_if((F.col("_n") == 1) & F.col("_old").isNull()).alias("new"), F.count_if((F.col("_n") > 1) | F.col("_old").isNotNull()).alias("duplicates")))
    kept = merged.join(fresh.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("added"))
    return merged, counts.crossJoin(kept).select("added", "duplicates", "rejected", (F.col("new") - F.col("added")).alias("skipped"))


def unexpired(cache: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Cached rows no older than the limit and not from further than it in the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp("cached_at")
    return cache.where((age <= days * 86400) & (age >= -days * 86400))


def watch_changes(pairs: DataFrame) -> DataFrame:
    """product_key, changes (array of kind, from, to): baseline (b_) against latest (l_) reading.

    Columns: b_/l_ band, rating, reviews, burst, drift.
    """
    told = lambda kind, hit: F.when(hit, F.struct(F.lit(kind).alias("kind"), F.col(f"b_{kind}").cast("string").alias("from"), F.col(f"l_{kind}").cast("string").alias("to")))
    both = lambda kind: F.col(f"b_{kind}").isNotNull() & F.col(f"l_{kind}").isNotNull()
    reviews = F.abs(F.col("l_reviews") - F.col("b_reviews")) >= F.greatest(F.lit(float(REVIEW_FLOOR)), F.col("b_reviews") * REVIEW_SHARE)
    rows = [
        told("band", both("band") & (F.col("b_band") != F.col("l_band"))),
        told("rating", both("rating") & (F.abs(F.col("l_rating") - F.col("b_rating")) >= RATING_STEP - SLACK)),
        told("reviews", both("reviews") & reviews),
        told("burst", both("burst") & (F.col("l_burst") - F.col("b_burst") >= BURST_STEP - SLACK)),
        told("drift", both("drift") & (F.col("b_drift") < DRIFT_AT) & (F.col("l_drift") >= DRIFT_AT)),
    ]
    return pairs.select("product_key", F.array_compact(F.array(*rows)).alias("changes"))


def changed_kinds(first: dict, latest: dict) -> list[str]:
    """Kinds of ``watch_changes`` between two readings (band, rating, reviews, burst, drift; None: not known)."""
    both = lambda kind: first[kind] is not None and latest[kind] is not None
    told = {
        "band": both("band") and first["band"] != latest["band"],
        "rating": both("rating") and abs(latest["rating"] - first["rating"]) >= RATING_STEP - SLACK,
        "reviews": both("reviews") and abs(latest["reviews"] - first["reviews"]) >= max(REVIEW_FLOOR, first["reviews"] * REVIEW_SHARE),
        "burst": both("burst") and latest["burst"] - first["burst"] >= BURST_STEP - SLACK,
        "drift": both("drift") and first["drift"] < DRIFT_AT <= latest["drift"],
    }
    return [kind for kind, hit in told.items() if hit]


def watch_state(readings: DataFrame) -> DataFrame:
    """product_key, checks, and the first (baseline) and last reading's columns as b_ and l_."""
    fields = [c for c in readings.columns if c not in ("product_key", "at", "id")]
    row = F.struct("at", "id", *fields)
    per = readings.groupBy("product_key").agg(F.count("*").alias("checks"), F.min(row).alias("b"), F.max(row).alias("l"))
    return per.select("product_key", "checks", *[F.col(f"b.{c}").alias(f"b_{c}") for c in fields], *[F.col(f"l.{c}").alias(f"l_{c}") for c in fields])


def pages_read(pages: DataFrame, group: str = "listing_id") -> DataFrame:
    """Rows of pages up to the first that is empty or brings no new key; pages: group, page, key (null: no row)."""
    first = pages.where("key IS NOT NULL").groupBy(group, "key").agg(F.min("page").alias("page"))
    fresh = first.groupBy(group, "page").agg(F.count("*").alias("fresh"))
    seen = pages.select(group, "page").distinct().join(fresh, [group, "page"], "left")
    stop = seen.where("fresh IS NULL").groupBy(group).agg(F.min("page").alias("stop"))
    return first.join(stop, group, "left").where("stop IS NULL OR page < stop").drop("stop")


def batches(queue: DataFrame, group: str, order: str, size: str, max_rows: int = 500, max_bytes: int = 2 << 20) -> DataFrame:
    """Adds batch: numbers of greedy batches in order, each within both limits (a larger row is alone)."""

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        out, batch, rows, total = [], 0, 0, 0
        for n in part[size]:
            if rows and (rows + 1 > max_rows or total + n > max_bytes):
                batch, rows, total = batch + 1, 0, 0
            rows, total = rows + 1, total + int(n)
            out.append(batch)
        return part.assign(batch=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queue.schema)
    return queue.groupBy(group).applyInPandas(cut, f"{fields}, batch long")


def due(queue: DataFrame, now: Column) -> DataFrame:
    """Entries whose time has come, oldest first."""
    return queue.where(F.col("ready_at") <= now).orderBy("ready_at")


def previous(entries: DataFrame, product_key: str, before: Column) -> DataFrame:
    """Earlier entries of a product, newest first."""
    return entries.where((F.col("product_key") == product_key) & (F.col("at") < before)).orderBy(F.col("at").desc(), F.col("id").desc())


def export_json(entries: DataFrame) -> DataFrame:
    """document: every entry as JSON, newest first (a line each)."""
    return entries.orderBy(F.col("at").desc(), F.col("id").desc()).select(F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"}).alias("document"))
