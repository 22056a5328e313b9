"""From pages to reports, and what is stored of them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import analyse, evaluate, model, notices, signals, store
from reviewlens.sources import files, reviews, rules
from reviewlens.streaming import ingest

FITTED = model.Model(-1.0, {"injected_share": 2.0, "duplicate_review_share": 1.0, "lift": 0.4}, [], {"lift": [0.5, 1.0, 2.0], "duplicate_review_share": [0.0, 0.0]})


def _page(title, n):
    body = [{"@type": "Review", "reviewRating": {"ratingValue": 1 + i % 5}, "reviewBody": f"words {i % 30} of a review {i % 30}", "datePublished": str(dt.date(2026, 1, 1) + dt.timedelta(days=i)), "author": {"@id": f"u{i}"}} for i in range(n)]
    return '<script type="application/ld+json">' + json.dumps({"@type": "Product", "name": title, "aggregateRating": {"@type": "AggregateRating", "ratingValue": 4.4}, "review": body}) + "</script>"


def test_pages_to_reports(spark):
    pages = spark.createDataFrame([(1, _page("Kettle", 50), None), (2, _page("Cup", 3), None), (3, "<p>nothing</p>", None)], "page_id long, html string, url string")
    read = reviews.read_pages(pages, {"shop": {"fields": rules.STANDARD}}, dt.date(2026, 6, 1)).cache()
    flagged = spark.createDataFrame([("u1",), ("u2",)], "reviewer_id string")
    slots = model.Slots(FITTED)
    rows = analyse.analyse(read, slots, flagged, resamples=20).cache()
    got = {r["listing_id"]: r for r in rows.collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "ok", 2: "not-enough-data", 3: "unreadable"}
    assert got[1]["low"] <= got[1]["high"] and got[1]["duplicate_review_share"] > 0 and got[1]["flagged_review_share"] == 0.04
    documents = analyse.report_documents(rows, F.lit(1700000000))
    assert [r["listing_id"] for r in documents.collect()] == [1]
    back = evaluate.reproduce(documents, slots).first()
    assert back["agrees"] and back["problem"] is None
    report = json.loads(documents.first()["document"])
    assert report["title"] == "Kettle" and report["report"]["claimedRating"] == 4.4 and report["report"]["totalReviewCount"] == 50 and set(report["features"]) == set(signals.FEATURES)
    text = analyse.report_lines(rows.where("listing_id = 1")).first()["text"]
    assert text.startswith("Kettle\nband: ") and "- duplicate text: " in text
    assert {r["listing_id"]: r["status"] for r in analyse.analyse(read, model.Slots(), texts=False).collect()} == {1: "no-model", 2: "not-enough-data", 3: "unreadable"}
    assert [r["band"] for r in analyse.bands(rows).collect()][-1] is None
    read.unpersist()
    rows.unpersist()


def test_expectations(spark):
    good = {"url": "https://x", "layout": "modern", "reviewCount": None, "claimedRating": 4.5, "title": "T", "minimumExtractedReviews": 2}
    row = analyse.expectations(spark.createDataFrame([("a", json.dumps(good))], "fixture string, value string")).first()
    assert (row["url"], row["review_count"], row["claimed_rating"], row["minimum_reviews"], row["known_failure"]) == ("https://x", None, 4.5, 2, None)
    for change in ({"url": ""}, {"layout": "odd"}, {"url": None}):
        with pytest.raises(ValueError):
            analyse.expectations(spark.createDataFrame([("a", json.dumps({**good, **change}))], "fixture string, value string"))
    for gone in ("reviewCount", "claimedRating", "layout"):
        with pytest.raises(ValueError):
            analyse.expectations(spark.createDataFrame([("a", json.dumps({k: v for k, v in good.items() if k != gone}))], "fixture string, value string"))


def test_flag_store(spark, tmp_path):
    flags = store.Flags(spark, str(tmp_path / "flags"))
    assert flags.matches("ab").count() == 0
    hashes = [f"{i:02x}{i * 7919 % 65536:04x}" for i in range(0, 256, 3)]
    flags.add(spark.createDataFrame([(h,) for h in hashes + hashes[:5]], "reviewer_hash string"))
    flags.add(spark.createDataFrame([(h,) for h in [*hashes[3:9], "ffffff"]], "reviewer_hash string"))
    assert sorted(r["reviewer_hash"] for r in flags.all().collect()) == sorted({*hashes, "ffffff"})
    assert [r["reviewer_hash"] for r in flags.matches("ff").collect()] == sorted(h for h in {*hashes, "ffffff"} if h.startswith("ff"))
    asked = spark.createDataFrame([("ffff",), (hashes[4][:4],), ("0101",), ("zzzz",)], "prefix string")
    got = {r["prefix"]: r["hashes"] for r in flags.answer(asked).collect()}
    assert got == {p: sorted(h for h in {*hashes, "ffffff"} if h.startswith(p)) for p in ("ffff", hashes[4][:4], "0101", "zzzz")}


def test_snapshot_times(spark, tmp_path):
    root = str(tmp_path / "s")
    assert files.snapshot_due(spark, root, 1_000_000_000.0)
    files.snapshot(spark.range(2), root, 1_000_000_000)
    assert files.snapshot_time(files.snapshots(spark, root)[0]) == 1_000_000_000.0 and files.snapshot_time("x") is None
    assert not files.snapshot_due(spark, root, 1_000_000_000.0 + 86_399) and files.snapshot_due(spark, root, 1_000_000_000.0 + 86_400)


def test_stream_figures(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("memory").queryName("figures").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    samples = ingest.progress_samples(query)
    lines = [r["line"] for r in notices.metrics_text(spark.createDataFrame(samples, "name string, kind string, help string, labels map<string,string>, value double")).collect()]
    assert 'stream_rows{query="figures"} 7.0' in lines
    now = dt.datetime.now(dt.timezone.utc).timestamp()
    assert ingest.health({"a": query, "b": None}, 600, now) == {"a": "ok", "b": "missing"} and ingest.health({"a": query}, 600, now + 9999) == {"a": "stale"}


def test_priors_document(spark):
    fitted = spark.createDataFrame([("home", 9, 900, *[0.2] * 5, False), ("rare", 1, 5, *[0.2] * 5, True), (None, 10, 905, *[0.2] * 5, False)], "key string, listings long, reviews long, h1 double, h2 double, h3 double, h4 double, h5 double, thin boolean")
    document = model.priors_document(fitted, F.lit(1)).first()["document"]
    priors, aliases = model.read_priors(spark, document)
    assert [r["key"] for r in priors.collect()] == ["home"] and aliases.count() == 0
    rows, dropped = model.complete(spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double"), ["a", "b"])
    assert (rows.count(), dropped) == (1, 1)
