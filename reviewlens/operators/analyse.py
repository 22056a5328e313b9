"""From pages to reports: the whole analysis of product pages, and report documents that a dispute can rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import stats
from reviewlens.functions import text as T
from reviewlens.operators import evaluate, model, report, signals


def page_reviews(read: DataFrame, key: str = "page_id") -> DataFrame:
    """Reviews of extracted pages in the shape of the signals: listing_id (the page's key), review_id (its place on the page) and the review's fields."""
    rows = read.select(F.col(key).alias("listing_id"), F.posexplode("reviews").alias("review_id", "r"))
    return rows.select("listing_id", "review_id", "r.rating", "r.text", F.col("r.date").alias("review_date"), "r.date_precision", "r.verified", "r.reviewer_id")


def page_products(read: DataFrame, key: str = "page_id") -> DataFrame:
    """listing_id and product_text of pages with a title."""
    return read.where("product IS NOT NULL").select(F.col(key).alias("listing_id"), evaluate.product_text(F.col("product.title"), F.col("product.category")).alias("product_text"))


def analyse(read: DataFrame, slots: model.Slots, flagged: DataFrame | None = None, key: str = "page_id", texts: bool = True, resamples: int = report.RESAMPLES) -> DataFrame:
    """A report row for each page.  status: unreadable, not-enough-data, no-model, missing-features or ok.

    read: what was extracted of the pages.  The interval is that of the local model's
    probability over resamples without the text signals being drawn again.
    """
    rows = page_reviews(read, key)
    vectors = signals.feature_vectors(rows, page_products(read, key), flagged, texts)
    scored = model.score_with_slots(vectors, slots)
    ratings = report.adjusted_rating(rows, vectors.select("listing_id", "injected_share"))
    text_columns = [c for c in vectors.columns if c in ("duplicate_review_share", "cluster_count", "largest_cluster_share", "off_topic_share", "mean_distance", "drift_statistic")]
    fixed = vectors.select("listing_id", *text_columns) if texts else None
    local = slots.local
    intervals = report.bootstrap_probability(rows, local, flagged, resamples, fixed=fixed) if local else scored.select("listing_id", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    made = report.reports(scored, ratings, intervals).join(vectors, "listing_id", "left")
    pages = read.select(F.col(key).alias("listing_id"), F.col("product.title").alias("title"), F.col("product.claimed_rating").alias("page_rating"))
    out = pages.join(made, "listing_id", "left")
    few = ~F.col("meets_minimum") | F.col("status").isin("not-enough-data", "insufficient-data")
    status = F.when(F.col("title").isNull() & F.col("n_reviews").isNull(), "unreadable").when(F.col("n_reviews").isNull() | few, "not-enough-data").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("meets_minimum")


def report_documents(rows: DataFrame, generated_at: Column, seed: str = "listing_id") -> DataFrame:
    """listing_id, document: reports with a probability as documents of version 2, with the features that the model was given."""
    fine = rows.where("probability IS NOT NULL")
    features = F.map_from_arrays(F.array(*map(F.lit, signals.FEATURES)), F.array(*[F.col(c) for c in signals.FEATURES.values()]))
    serial = T.serial(F.concat_ws(":", F.col(seed).cast("string"), generated_at.cast("string")))
    body = F.struct(
        serial.alias("serial"),
        "band",
        "probability",
        F.coalesce("page_rating", "claimed").alias("claimedRating"),
        F.col("adjusted").alias("adjustedRating"),
        F.col("n_reviews").alias("totalReviewCount"),
        F.col("excluded").alias("excludedReviewCount"),
        F.coalesce("injected_share", F.lit(0.0)).alias("estimatedInorganicShare"),
        F.struct("low", "high").alias("confidence"),
        "evidence",
        model.signal_names(F.col("imputed")).alias("unavailableSignals"),
        generated_at.alias("generatedAt"),
    )
    document = F.to_json(F.struct(F.lit(evaluate.DOCUMENT_VERSION).alias("documentVersion"), "title", body.alias("report"), features.alias("features")), {"ignoreNullFields": "false"})
    return fine.select("listing_id", document.alias("document"))


def report_lines(rows: DataFrame) -> DataFrame:
    """listing_id, text: a report for people, a line for each figure and each signal."""
    signs = F.transform("evidence", lambda e: F.concat(F.lit("- "), e["signal"], F.lit(": "), e["strength"]))
    head = [
        F.col("title"),
        F.concat(F.lit("band: "), F.coalesce("band", F.lit("none"))),
        F.when(F.col("probability").isNotNull(), F.format_string("probability: %.2f (%.2f to %.2f)", "probability", "low", "high")),
        F.when(F.col("adjusted").isNotNull(), F.format_string("rating: %.1f without %d of %d reviews", "adjusted", "excluded", "n_reviews")),
    ]
    return rows.select("listing_id", F.concat_ws("\n", *head, F.array_join(signs, "\n")).alias("text"))


def expectations(texts: DataFrame, key: str = "fixture", column: str = "value") -> DataFrame:
    """``key``, url, layout, title, category, claimed_rating, review_count, minimum_reviews and known_failure of expectation documents; raises if one is incomplete.

    A document must name its url, a layout (modern or legacy), and reviewCount and
    claimedRating, which are null where the page has none.
    """
    fields = "url string, layout string, title string, category string, claimedRating double, reviewCount double, minimumExtractedReviews int, knownFailure string"
    rows = texts.withColumn("_e", F.from_json(column, fields)).withColumn("_k", F.json_object_keys(column))
    named = F.col("_e.url").isNotNull() & (F.col("_e.url") != "") & F.col("_e.layout").isin("modern", "legacy")
    present = F.array_contains("_k", "reviewCount") & F.array_contains("_k", "claimedRating")
    bad = rows.where(~F.coalesce(named & present, F.lit(False))).select(key).limit(5).collect()
    if bad:
        raise ValueError(f"incomplete expectations: {sorted(str(r[0]) for r in bad)}")
    e = lambda name, alias=None: F.col(f"_e.{name}").alias(alias or name)
    return rows.select(key, e("url"), e("layout"), e("title"), e("category"), e("claimedRating", "claimed_rating"), e("reviewCount", "review_count"), e("minimumExtractedReviews", "minimum_reviews"), e("knownFailure", "known_failure"))


def bands(rows: DataFrame) -> DataFrame:
    """band, n: how many reports there are of each band, in the bands' order, with those that have none."""
    order = F.create_map(*[F.lit(x) for i, b in enumerate(stats.BANDS) for x in (b, i)])
    return rows.groupBy("band").agg(F.count("*").alias("n")).orderBy(F.coalesce(F.try_element_at(order, F.col("band")), F.lit(len(stats.BANDS))))
