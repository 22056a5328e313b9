"""Evaluation and audit of a stored model, rerunning of disputed reports, and building a corpus from labelled pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import model, signals
from reviewlens.sources.reviews import TOLERANCE

# Versions of report and method documents, and the first that carries features.
DOCUMENT_VERSION, FEATURES_FROM, METHOD_VERSION = 2, 2, 1
GRAPH_SLOT, LOCAL_SLOT = "reviewerGraph", "local"


# -- evaluation ------------------------------------------------------------------------


def evaluate(examples: DataFrame, fitted: model.Model, threshold: float = 0.5, label: str = "label") -> DataFrame:
    """evaluated, skipped, imputed, precision, recall, f1 at the threshold and ece: one row.  examples: label and the features' columns."""
    scored = model.score(examples, fitted).withColumn("_ok", F.col("probability").isNotNull())
    counts = scored.agg(F.count_if("_ok").alias("evaluated"), F.count_if(~F.col("_ok")).alias("skipped"), F.count_if(F.col("_ok") & (F.size("imputed") > 0)).alias("imputed"))
    rates = model.rates(model.confusion(scored, threshold, label=label)).select("precision", "recall", "f1")
    error = model.calibration_error(scored, label=label).select(F.coalesce("ece", F.lit(0.0)).alias("ece"))
    # three tables of one row
    return counts.crossJoin(rates).crossJoin(error)


def audit(examples: DataFrame, slots: model.Slots, slot: str = LOCAL_SLOT, digest: str | None = None, known: set[str] = frozenset(), label: str = "label") -> DataFrame:
    """``evaluate``'s row of a stored model, with threshold, problems, corpus_priors and priors_match.

    digest: of the priors that the model was trained under; known: digests of the
    priors that there are now.  examples: also priors, the digest a row was built with.
    """
    fitted = {LOCAL_SLOT: slots.local, GRAPH_SLOT: slots.graph}.get(slot)
    if fitted is None:
        raise ValueError(f"there is no model in slot {slot!r}")
    if examples.isEmpty():
        raise ValueError("the corpus holds no examples")
    scored = model.score(examples, fitted)
    point = model.acceptance(scored, label=label).select("threshold", "problems")
    digests = examples.agg(F.sort_array(F.collect_set("priors")).alias("corpus_priors"))
    known_now = F.array(*[F.lit(k) for k in sorted(known)]) if known else F.array().cast("array<string>")
    stale = F.when(F.lit(digest is None), F.lit("the model records no priors")).when(~F.array_contains(known_now, F.lit(digest or "")), F.lit("the model was trained under other priors"))
    rows = evaluate(examples, fitted, label=label).crossJoin(point).crossJoin(digests)
    return rows.withColumn("problems", F.array_compact(F.concat("problems", F.array(stale)))).withColumn("priors_match", F.size(F.array_except("corpus_priors", known_now)) == 0)


def method_document(report: DataFrame, fitted: model.Model, trained_at: Column, held_out: int) -> DataFrame:
    """document: what is published of a trained model (report: the row of ``audit``)."""
    accuracy = F.struct(F.col("threshold").alias("decisionThreshold"), "precision", "recall", F.col("ece").alias("expectedCalibrationError"), F.col("evaluated").alias("evaluatedCount"), F.col("imputed").alias("imputedCount"), F.lit(held_out).alias("heldOutCount"))
    criteria = F.struct(F.lit(model.MIN_PRECISION).alias("minimumPrecision"), F.lit(model.MIN_RECALL).alias("minimumRecall"), F.lit(model.MAX_ECE).alias("maximumExpectedCalibrationError"), (F.size("problems") == 0).alias("met"), "problems")
    weights = F.create_map(*[F.lit(x) for k in sorted(fitted.coefficients) for x in (k, float(fitted.coefficients[k]))])
    curve = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in fitted.calibration])
    fields = [F.lit(METHOD_VERSION).alias("documentVersion"), F.lit(True).alias("published"), trained_at.alias("trainedAt"), F.lit(fitted.intercept).alias("intercept"), weights.alias("coefficients"), accuracy.alias("accuracy"), criteria.alias("criteria"), curve.alias("calibration")]
    return report.select(F.to_json(F.struct(*fields)).alias("document"))


def absent_document(reason: str) -> str:
    """The method document where no model is published."""
    return json.dumps({"documentVersion": METHOD_VERSION, "published": False, "reason": reason}, sort_keys=True)


# -- disputes ---------------------------------------------------------------------------

_REPORT = "struct<serial: string, band: string, probability: double, claimedRating: double, adjustedRating: double, totalReviewCount: double, excludedReviewCount: double, unavailableSignals: array<string>, absentSignals: array<string>>"


def read_reports(documents: DataFrame, column: str = "document") -> DataFrame:
    """``documents`` with version, title, report (struct), features (feature name -> value) and blocked: why it can't be rerun (null: it can).

    Tolerant of fields of other types (they are null); a document without a version
    or a report, or of a newer version, is blocked.
    """
    parsed = documents.withColumn("_d", F.from_json(column, f"documentVersion int, title string, report {_REPORT}, features map<string, double>"))
    out = parsed.withColumns({"version": F.col("_d.documentVersion"), "title": F.coalesce("_d.title", F.lit("")), "report": F.col("_d.report"), "features": F.coalesce("_d.features", F.create_map().cast("map<string, double>"))}).drop("_d")
    blocked = (
        F.when(F.col("version").isNull(), "the document names no version")
        .when(F.col("version") > DOCUMENT_VERSION, "the document is of a newer version")
        .when(F.col("report").isNull(), "the document carries no report")
        .when(F.col("version") < FEATURES_FROM, "documents of this version carry no features")
        .when(F.size("features") == 0, "the document carries no features")
        .when(F.col("report.probability").isNull(), "the report records no probability")
    )
    return out.withColumn("blocked", blocked)


def reproduce(documents: DataFrame, slots: model.Slots, column: str = "document") -> DataFrame:
    """``documents`` with slot, claimed, probability, difference, agrees and problem: each report scored again from its own features.

    The graph model where there is one and the document has the flagged share, else the local one.
    """
    if slots.local is None:
        raise ValueError("there is no model to rerun against")
    read = read_reports(documents, column)
    names = {key: c for key, c in signals.FEATURES.items()}
    wide = read.select("*", *[F.try_element_at("features", F.lit(key)).alias(f"_f_{c}") for key, c in names.items()])
    graph = F.lit(slots.graph is not None) & F.col("_f_flagged_review_share").isNotNull()

    def with_prefix(m: model.Model) -> model.Model:
        return model.Model(m.intercept, {f"_f_{k}": v for k, v in m.coefficients.items()}, m.calibration, {f"_f_{k}": v for k, v in m.sketches.items()})

    keep = [*documents.columns, "blocked", "report", "slot", "status", "probability"]
    local = model.score(wide.where(~graph).withColumn("slot", F.lit(LOCAL_SLOT)), with_prefix(slots.local)).select(*keep)
    scored = local if slots.graph is None else local.unionByName(model.score(wide.where(graph).withColumn("slot", F.lit(GRAPH_SLOT)), with_prefix(slots.graph)).select(*keep))
    p = F.when(F.col("blocked").isNull(), F.col("probability"))
    out = scored.withColumns({"claimed": F.col("report.probability"), "probability": p}).withColumn("difference", F.col("probability") - F.col("claimed"))
    off = F.abs("difference") > TOLERANCE
    problem = F.coalesce(
        F.col("blocked"),
        F.when(F.col("status") == "missing-features", "the model needs features that the document doesn't carry"),
        F.when(F.col("status") == "insufficient-data", "no feature of the model is in the document"),
        F.when(off, F.format_string("the model reads %.6f where the report has %.6f", "probability", "claimed")),
    )
    return out.select(*documents.columns, "slot", "claimed", "probability", "difference", F.coalesce(~off, F.lit(False)).alias("agrees"), problem.alias("problem"))


# -- a corpus from labelled pages --------------------------------------------------------


def example_id(fixture: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a page's name."""
    return F.substring(F.sha2(fixture, 256), 1, 16)


def product_text(title: Column, category: Column) -> Column:
    """Title, and category if there is one."""
    return F.concat_ws(" ", title, category)


def paired(pages: DataFrame, expected: DataFrame, key: str = "fixture") -> DataFrame:
    """Pages with their expectations; raises if either half of a pair is missing."""
    left, right = pages.withColumn("_p", F.lit(True)), expected.withColumn("_e", F.lit(True))
    joined = left.join(right, key, "full")
    bad = joined.where("_p IS NULL OR _e IS NULL").select(key).limit(5).collect()
    if bad:
        raise ValueError(f"pages without a pair: {sorted(str(r[0]) for r in bad)}")
    return joined.drop("_p", "_e")


def featurise(labels: DataFrame, read: DataFrame, products: DataFrame, flagged: DataFrame | None = None, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Examples (example_id, fixture, label, priors_key and the flat features) and what was skipped (fixture, reason).

    labels: fixture, label; read: what was extracted of each page (fixture, product,
    reviews); products: fixture, priors_key.
    """
    named = labels.select("fixture", "label").join(read.select("fixture", "product", "reviews"), "fixture", "left").join(products.select("fixture", "priors_key"), "fixture", "left")
    rows = named.where("product IS NOT NULL").select("fixture", F.posexplode("reviews").alias("review_id", "r"))
    rows = rows.select(F.col("fixture").alias("listing_id"), "review_id", "r.rating", "r.text", F.col("r.date").alias("review_date"), "r.date_precision", "r.verified", "r.reviewer_id")
    about = named.where("product IS NOT NULL").select(F.col("fixture").alias("listing_id"), product_text(F.col("product.title"), F.col("product.category")).alias("product_text"))
    vectors = signals.feature_vectors(rows, about, flagged, texts).withColumnRenamed("listing_id", "fixture")
    j = named.drop("reviews").join(vectors, "fixture", "left")
    enough = F.coalesce("meets_minimum", F.lit(False))
    examples = j.where((F.col("product").isNotNull()) & enough).select(example_id(F.col("fixture")).alias("example_id"), "fixture", "label", "priors_key", *signals.FEATURES.values())
    reason = F.when(F.col("product").isNull(), "nothing could be read of the page").when(~enough, "too few reviews or dates")
    return examples, j.select("fixture", reason.alias("reason")).where("reason IS NOT NULL")


def corpus_counts(examples: DataFrame, *by: str) -> DataFrame:
    """by, value, n: examples by each of the columns, in one pass."""
    sets = examples.select(F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in by])).alias("x"))
    return sets.groupBy("x.by", "x.value").agg(F.count("*").alias("n"))


def dangling_aliases(aliases: DataFrame, priors: DataFrame) -> DataFrame:
    """Aliases whose target has neither priors nor a further alias."""
    return aliases.join(priors.select(F.col("key").alias("target")), "target", "left_anti").join(aliases.select(F.col("alias").alias("target")), "target", "left_anti").select("alias", "target")
