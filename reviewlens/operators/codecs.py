"""JSON documents of reviews, products, feature vectors, stored reports and watch readings, to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import stats
from reviewlens.operators import model, signals

REVIEW = "struct<rating: double, text: string, date: string, datePrecision: string, verified: boolean, reviewerId: string>"
PRODUCT = "struct<title: string, category: string, claimedRating: double, reviewCount: long, site: string, locale: string, url: string, thumbnailUrl: string>"
#: The groups of a stored vector: required ones fail the vector if anything of them is missing.
_PARTS = {
    "ratingDeconvolution": {"injectedShare": True, "residualError": True},
    "temporalBurst": {"burstFraction": True, "burstCount": True, "largestBurstShare": True},
    "verificationConcentration": {"lift": False, "baseCount": True},
    "textNearDuplication": {"duplicateReviewShare": False, "clusterCount": True, "largestClusterShare": True},
    "listingDrift": {"offTopicShare": False, "offTopicCount": True, "meanDistance": False, "driftStatistic": True, "embeddedCount": True},
    "reviewerGraph": {"flaggedReviewShare": False, "flaggedReviewCount": True, "flaggedReviewerCount": True, "knownReviewerCount": True, "identifiedReviewCount": True},
}
_REQUIRED = ("textNearDuplication", "listingDrift")


def review_json() -> Column:
    """A review as JSON: nulls are written, but a precision only if it isn't exact."""
    fields = ["rating", "text", F.date_format("review_date", "yyyy-MM-dd").alias("date"), "verified", F.col("reviewer_id").alias("reviewerId")]
    full = {"ignoreNullFields": "false"}
    exact = F.coalesce("date_precision", F.lit("exact")) == "exact"
    return F.when(exact, F.to_json(F.struct(*fields), full)).otherwise(F.to_json(F.struct(*fields, F.col("date_precision").alias("datePrecision")), full))


def parse_review(document: Column) -> Column:
    """struct(rating, text, review_date, date_precision, verified, reviewer_id) of a review's JSON; null for what isn't an object."""
    r = F.from_json(document, REVIEW)
    fields = F.struct(r["rating"].alias("rating"), r["text"].alias("text"), F.try_to_date(r["date"], "yyyy-MM-dd").alias("review_date"), r["datePrecision"].alias("date_precision"), r["verified"].alias("verified"), r["reviewerId"].alias("reviewer_id"))
    return F.when(r.isNotNull(), fields)


def parse_extraction(outputs: DataFrame, column: str = "output") -> DataFrame:
    """``outputs`` with site, locale, rules_version, product, reviews and readings of an extractor's JSON; raises if a required field is missing."""
    reading = "struct<field: string, health: string, depth: int, tiers: int, strategy: string, source: string>"
    rows = outputs.withColumn("_o", F.from_json(column, f"site string, locale string, rulesVersion int, product {PRODUCT}, reviews array<{REVIEW}>, readings array<{reading}>"))
    bad = rows.where("_o.rulesVersion IS NULL OR _o.reviews IS NULL").count()
    if bad:
        raise ValueError(f"{bad} outputs of the extractor lack a required field")
    return rows.select(*outputs.columns, "_o.site", "_o.locale", F.col("_o.rulesVersion").alias("rules_version"), "_o.product", "_o.reviews", F.coalesce("_o.readings", F.array().cast(f"array<{reading}>")).alias("readings"))


def _number(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def vector_json(vectors: DataFrame, key: str = "listing_id") -> DataFrame:
    """``key``, document: the flat features of each row as nested JSON (a group that is null as a whole is null)."""
    groups: dict[str, list[tuple[str, str]]] = {}
    for name, column in signals.FEATURES.items():
        group, leaf = name.split(".")
        groups.setdefault(group, []).append((leaf, column))
    parts = [F.lit(True).alias("meetsMinimumData") if "meets_minimum" not in vectors.columns else F.col("meets_minimum").alias("meetsMinimumData")]
    for group, leaves in groups.items():
        known = F.coalesce(*[F.col(c) for _, c in leaves]).isNotNull()
        extra = [F.lit(0).alias(leaf) for leaf, needed in _PARTS[group].items() if needed and leaf not in dict(leaves)]
        body = F.struct(*[(F.coalesce(F.col(c), F.lit(0.0)) if _PARTS[group][leaf] else F.col(c)).alias(leaf) for leaf, c in leaves], *extra)
        parts.append((body if group in _REQUIRED else F.when(known, body)).alias(group))
    return vectors.select(key, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("document"))


def parse_vectors(documents: DataFrame, column: str = "document") -> DataFrame:
    """``documents`` with readable, meets_minimum and the flat features.

    A document in which a number that its group needs is missing or isn't a finite
    number is unreadable as a whole: no feature of it is taken.
    """
    leaf = ", ".join
    schema = "meetsMinimumData boolean, " + leaf(f"{g} struct<{leaf(f'{n}: double' for n in names)}>" for g, names in _PARTS.items())
    rows = documents.withColumn("_v", F.from_json(column, schema))
    fine = F.col("_v.meetsMinimumData").isNotNull()
    values: dict[str, Column] = {}
    for group, names in _PARTS.items():
        body = F.col(f"_v.{group}")
        whole = F.lit(True)
        for name, needed in names.items():
            # only a number reads as one; what is null must be null in the document, too
            number = _number(F.col(f"_v.{group}.{name}"))
            present = F.json_object_keys(F.get_json_object(column, f"$.{group}"))
            null = F.array_contains(present, name) & F.get_json_object(column, f"$.{group}.{name}").isNull()
            whole = whole & (number.isNotNull() if needed else number.isNotNull() | null)
            values[f"{group}.{name}"] = number
        fine = fine & (F.coalesce(whole, F.lit(False)) if group in _REQUIRED else body.isNull() | F.coalesce(whole, F.lit(False)))
    rows = rows.withColumn("readable", F.coalesce(fine, F.lit(False)))
    kept = [F.when(F.col("readable"), values[name]).alias(c) for name, c in signals.FEATURES.items()]
    return rows.select(*documents.columns, "readable", F.when(F.col("readable"), F.col("_v.meetsMinimumData")).alias("meets_minimum"), *kept)


def rescore(entries: DataFrame, slots: model.Slots) -> DataFrame:
    """Stored entries with flat features: rescored_band, rescored_probability and unavailable (names of imputed signals) under the present model; null where it can't say."""
    scored = model.score_with_slots(entries, slots)
    ok = F.col("status") == "ok"
    return scored.select(*entries.columns, F.when(ok, stats.band(F.col("probability"))).alias("rescored_band"), F.when(ok, F.col("probability")).alias("rescored_probability"), F.when(ok, model.signal_names(F.col("imputed"))).alias("unavailable"))


def split_imputed(imputed: Column, absent: list[str]) -> tuple[Column, Column]:
    """Names of imputed signals: those that couldn't be read, and those that the platform never records (``absent``: feature groups)."""
    never = [c for key, c in signals.FEATURES.items() if key.split(".")[0] in absent]
    gone = F.array(*[F.lit(c) for c in never]) if never else F.array().cast("array<string>")
    return model.signal_names(F.array_except(imputed, gone)), model.signal_names(F.array_intersect(imputed, gone))


_STORED = "struct<serial: string, band: string, probability: double, claimedRating: double, adjustedRating: double, totalReviewCount: double, excludedReviewCount: double, estimatedInorganicShare: double, confidence: struct<low: double, high: double>, generatedAt: double>"


def parse_stored(reports: DataFrame, column: str = "report") -> DataFrame:
    """``reports`` with stored: the report's struct, null if a number or the band of it can't be read."""
    r = F.from_json(column, _STORED)
    rows = reports.withColumn("_r", r)
    need = ["probability", "claimedRating", "adjustedRating", "totalReviewCount", "excludedReviewCount", "generatedAt"]
    fine = F.coalesce(F.col("_r.band").isin(*stats.BANDS), F.lit(False)) & F.col("_r.serial").isNotNull()
    for c in need:
        fine = fine & _number(F.col(f"_r.{c}")).isNotNull()
    return rows.withColumn("stored", F.when(F.coalesce(fine, F.lit(False)), F.col("_r"))).drop("_r")


def watch_reading(band: Column, rating: Column, reviews: Column, burst: Column, drift: Column) -> Column:
    """struct(band, rating, reviews, burst, drift) of what a watch compares; numbers that aren't finite are null."""
    return F.struct(F.when(band.isin(*stats.BANDS), band).alias("band"), *[_number(c.cast("double")).alias(n) for n, c in (("rating", rating), ("reviews", reviews), ("burst", burst), ("drift", drift))])


def change_text(change: Column) -> Column:
    """A sentence for one change (struct of kind, from, to)."""
    kind, a, b = change["kind"], change["from"], change["to"]
    num = lambda c: c.try_cast("double")
    return (
        F.when(kind == "band", F.concat_ws(" ", F.lit("band: was"), a, F.lit("and is"), b))
        .when(kind == "rating", F.format_string("rating: from %.1f to %.1f", num(a), num(b)))
        .when(kind == "reviews", F.concat_ws(" ", F.lit("reviews: from"), F.format_number(num(a), 0), F.lit("to"), F.format_number(num(b), 0)))
        .when(kind == "burst", F.format_string("bursts: from %d to %d percent of the reviews", F.round(num(a) * 100).cast("long"), F.round(num(b) * 100).cast("long")))
        .when(kind == "drift", F.lit("the reviews have turned to another product"))
    )


def watch_status(products: DataFrame, watched: DataFrame, key: str = "product_key") -> DataFrame:
    """``products`` with watched, checks and since: whether each is watched (not by default)."""
    w = watched.select(key, F.lit(True).alias("_w"), "checks", F.col("saved_at").alias("since"))
    return products.join(w, key, "left").withColumn("watched", F.coalesce("_w", F.lit(False))).withColumn("checks", F.coalesce("checks", F.lit(0))).drop("_w")
