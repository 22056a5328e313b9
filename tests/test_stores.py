"""Stores, codecs, lookups, disputes and canary runs on small literals."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.operators import canary, codecs, evaluate, history, lookup, model, signals, store
from reviewlens.plans.pages import SITES
from reviewlens.sources import sites

T0 = dt.datetime(2026, 3, 1, 12)


def now():
    return F.lit("2026-03-08 12:00:00").cast("timestamp")


EDGE = "id long, reviewer_hash string, product_hash string, star_rating int, week_bucket int, verified boolean, received_at timestamp"


def test_keyed_table(spark, tmp_path):
    t = store.Keyed(spark, str(tmp_path / "watch"), "product_key string, saved_at timestamp, band string", "product_key", ["saved_at", "product_key"], cap=3)
    assert t.count() == 0 and t.first("saved_at") is None
    rows = [(f"p{i}", T0 + dt.timedelta(days=i), "mixed") for i in range(5)]
    t.put(spark.createDataFrame(rows, t.schema))
    assert [r["product_key"] for r in t.listed().collect()] == ["p4", "p3", "p2"]
    t.put(spark.createDataFrame([("p3", T0 + dt.timedelta(days=9), "clean"), ("p3", T0, "doubtful")], t.schema))
    assert t.read("p3").first()["band"] == "clean" and t.listed().first()["product_key"] == "p3"
    before = t.all()
    t.delete(spark.createDataFrame([("p4",)], "product_key string"))
    assert before.count() == 3 and t.count() == 2 and t.first("saved_at") == T0 + dt.timedelta(days=2)
    t.clear()
    assert t.count() == 0


def test_claims(spark, tmp_path):
    at = lambda i: T0 + dt.timedelta(hours=i)
    rows = [(3, "r", "p", 5, 1, None, at(3)), (1, "r", "p", 5, 1, None, at(1)), (2, "r", "p", 5, 1, True, at(2)), (4, "s", "p", 5, 1, False, at(4)), (5, "s", "p", 5, 1, False, at(5))]
    edges = spark.createDataFrame(rows, EDGE)
    assert sorted(r["id"] for r in store.collapse(edges).collect()) == [1, 2, 4]
    assert sorted(r["id"] for r in store.unclaimed(edges, edges.where("id = 3")).collect()) == [2, 4]
    assert sorted(r["id"] for r in store.list_since(edges, F.lit(str(at(3))).cast("timestamp")).collect()) == [3, 4, 5]
    days = edges.withColumn("day", F.expr("date_add(to_date(received_at), cast(id as int))"))
    days.write.partitionBy("day").parquet(str(tmp_path / "edges"))
    assert store.prune_older(spark, str(tmp_path / "edges"), F.lit("2026-03-04 00:00:00").cast("timestamp")) == 2
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "edges")).collect()) == [3, 4, 5]
    assert store.prune_older(spark, str(tmp_path / "none"), now()) == 0


def test_review_sketches(spark):
    reviews = spark.createDataFrame([(1, "Great phone", T0), (2, "", T0), (3, None, T0 - dt.timedelta(days=30)), (4, "x", T0 + dt.timedelta(days=30))], "id long, text string, cached_at timestamp")
    held = store.sketched(reviews).cache()
    assert "text" not in held.columns and sorted(r["id"] for r in held.where("text_signature IS NOT NULL").collect()) == [1, 4]
    assert sorted(r["id"] for r in store.cached(held, F.lit("2026-03-05 00:00:00").cast("timestamp")).collect()) == [1, 2]
    assert store.cached(held.withColumn("permutations", F.lit(64)), now()).count() == 0
    row = held.where("id = 1").select(store.unit_terms(F.col("text_terms")).alias("u"), store.unit_terms(F.create_map(F.lit(256), F.lit(1))).alias("bad"), T.embedding(T.terms(F.lit("Great phone"))).alias("e")).first()
    assert row["bad"] is None and max(abs(a - b) for a, b in zip(row["u"], row["e"], strict=True)) < 1e-12
    assert math.isclose(spark.range(1).select(store.cosine(F.array(F.lit(0.6), F.lit(0.8)), F.array(F.lit(0.6), F.lit(0.8))).alias("c")).first()["c"], 1.0)
    keys = spark.createDataFrame([("s", "p")], "s string, p string").select(store.cache_key(F.col("s"), F.col("p")).alias("k")).first()["k"]
    assert keys == __import__("hashlib").sha256(b"s:p").hexdigest()


def test_signature_from_text(spark):
    texts = ["Hello  World again", "hi", "", None, "naïve 🙂 café ☕ test", "日本語のテキストです"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", T.fold_space(F.col("t")))
    rows = d.select("i", T.signature(F.col("f")).alias("a"), T.minhash(T.shingles(F.col("t"))).alias("b"), T.shingle_count("f").alias("n"), F.size(T.shingles(F.col("t"))).alias("m")).orderBy("i").collect()
    for r in rows:
        assert r["a"] == r["b"] and (r["n"] == r["m"] or texts[r["i"]] is None), r["i"]
    pairs = T.read_coefficients(json.dumps([["3", "5"], ["7", "0"]]))
    own = d.where("i = 0").select(T.signature(F.col("f"), pairs).alias("s")).first()["s"]
    grams = {"hello world again"[i : i + 5] for i in range(13)}
    hashes = [T.fnv1a64_of(g.encode()) % T.MERSENNE for g in grams]
    assert own == [min((a * h + b) % T.MERSENNE for h in hashes) for a, b in ((3, 5), (7, 0))]
    for bad in ("[]", '[["0", "1"]]', json.dumps([["1", "1"]] * 129)):
        with pytest.raises(ValueError):
            T.read_coefficients(bad)


def test_grams_of_large_alphabets():
    texts = ["".join(chr(0x4E00 + (i * 37 + j * 101) % 9000) for j in range(300)) for i in range(30)] + ["", "ab", "abcde", "abcdef"]
    grams = T.Grams(texts)
    assert grams.words == 2
    points, inverse = grams.unique()
    names = ["".join(map(chr, row[row > 0])) for row in points]
    assert len(set(names)) == len(names)
    for i, t in enumerate(texts):
        own = {names[k] for k in inverse[grams.offsets[i] : grams.offsets[i + 1]]}
        assert own == ({t[j : j + 5] for j in range(len(t) - 4)} if len(t) > 5 else {t} if t else set())
    assert T.fnv1a64_points(points).tolist() == [T.fnv1a64_of(n.encode()) for n in names]


def test_queue(spark):
    edges = spark.createDataFrame([(i, 1000 if i < 9 else 5000) for i in range(10)], "id long, size int")
    queue = spark.createDataFrame([], "id long, size int, ready_at timestamp")
    held = store.enqueue(queue, edges, now(), seed=1, cap=8).cache()
    assert held.count() == 8 and store.enqueue(held, edges, now(), cap=8).count() == 8
    low, high = held.agg(F.min("ready_at"), F.max("ready_at")).first()
    assert dt.datetime(2026, 3, 8, 13) <= low < high <= dt.datetime(2026, 3, 8, 18)
    late = F.lit("2026-03-08 19:00:00").cast("timestamp")
    assert store.defer(held, late).where(F.col("ready_at") < late).count() == 0
    full = store.enqueue(queue, edges, now(), cap=20)
    batches, never = store.flush(full, late, most=3000)
    assert [r["id"] for r in never.collect()] == [9]
    sizes = batches.groupBy("batch").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 9 and max(r["s"] for r in sizes) <= 3000
    sent = batches.select("id", F.when(F.col("batch") == 0, 200).when(F.col("batch") == 1, 400).otherwise(429).alias("code"))
    left = store.settle(full, sent, F.col("code"), late)
    kept = {r["id"]: r["ready_at"] for r in left.collect()}
    assert set(kept) == {r["id"] for r in sent.where("code = 429").collect()} | {9} and kept[next(iter(set(kept) - {9}))] == dt.datetime(2026, 3, 8, 19)


def test_holdings(spark):
    cache = spark.createDataFrame([(T0,)], "cached_at timestamp")
    queue = spark.createDataFrame([(dt.datetime(2026, 3, 8, 14),)], "ready_at timestamp")
    row = store.holdings(spark.range(1234), spark.range(1), cache, queue)
    assert [r["line"] for r in store.holdings_lines(row, now()).collect()] == ["stored: 1,234 checks", "watched: 1 listing", "cached: 1 listing, the oldest of 7 days ago", "to be sent: 1 row, the first in 2 hours"]
    empty = store.holdings(spark.range(0), spark.range(0), cache.where("false"), queue.where("false"))
    assert [r["line"] for r in store.holdings_lines(empty, now()).collect()][3] == "to be sent: 0 rows"


def test_review_codec(spark):
    rows = [(4.0, "Good", dt.date(2026, 1, 2), None, True, "u1"), (None, None, None, "month", None, None), (5.0, 'q"', dt.date(2026, 1, 2), "week", False, None)]
    reviews = spark.createDataFrame(rows, "rating double, text string, review_date date, date_precision string, verified boolean, reviewer_id string")
    coded = reviews.select(codecs.review_json().alias("j"))
    texts = [json.loads(r["j"]) for r in coded.collect()]
    assert texts[0] == {"rating": 4.0, "text": "Good", "date": "2026-01-02", "verified": True, "reviewerId": "u1"} and texts[1]["datePrecision"] == "month"
    back = [tuple(r["r"]) for r in coded.select(codecs.parse_review(F.col("j")).alias("r")).collect()]
    assert back == rows
    outputs = spark.createDataFrame([('{"rulesVersion": 3, "site": "s", "reviews": [{"rating": 2}], "product": null}',)], "output string")
    got = codecs.parse_extraction(outputs).first()
    assert (got["rules_version"], got["product"], got["reviews"][0]["rating"], got["readings"]) == (3, None, 2.0, [])
    with pytest.raises(ValueError):
        codecs.parse_extraction(spark.createDataFrame([("{}",)], "output string"))


def test_vector_codec(spark):
    names = list(signals.FEATURES.values())
    rows = [(1, True, *[0.5] * 13), (2, False, *[None] * 5, None, None, 0.0, 0.0, None, None, 0.0, None)]
    vectors = spark.createDataFrame(rows, "listing_id long, meets_minimum boolean, " + ", ".join(f"{n} double" for n in names))
    documents = codecs.vector_json(vectors)
    back = {r["listing_id"]: r for r in codecs.parse_vectors(documents).collect()}
    for k, meets, *values in rows:
        assert back[k]["readable"] and back[k]["meets_minimum"] == meets and [back[k][n] for n in names] == values
    good = json.loads(documents.where("listing_id = 1").first()["document"])
    broken = []
    for change in ({"meetsMinimumData": 1}, {"listingDrift": None}, {"temporalBurst": {"burstCount": 1}}, {"ratingDeconvolution": {"injectedShare": "0.5", "residualError": 0.1}}, {"verificationConcentration": {"baseCount": 3}}):
        broken.append((json.dumps({**good, **change}),))
    rows = codecs.parse_vectors(spark.createDataFrame([*broken, ("{",), (None,)], "document string")).collect()
    assert not any(r["readable"] or r["injected_share"] is not None for r in rows)


def test_stored_reports_and_watches(spark):
    good = {"serial": "A", "band": "mixed", "probability": 0.5, "claimedRating": 4, "adjustedRating": 3.5, "totalReviewCount": 9, "excludedReviewCount": 1, "generatedAt": 1}
    rows = [(json.dumps(good),), (json.dumps({**good, "band": "odd"}),), (json.dumps({**good, "probability": None}),), ("no",)]
    stored = [r["stored"] for r in codecs.parse_stored(spark.createDataFrame(rows, "report string")).collect()]
    assert stored[0]["band"] == "mixed" and stored[1:] == [None, None, None]
    reading = spark.range(1).select(codecs.watch_reading(F.lit("odd"), F.lit(4), F.lit(float("nan")), F.lit(None), F.lit(0.5)).alias("r")).first()["r"]
    assert tuple(reading) == (None, 4.0, None, None, 0.5)
    changes = spark.createDataFrame([("band", "clean", "mixed"), ("rating", "4.04", "3.5"), ("reviews", "1200", "40"), ("burst", "0.1", "0.25"), ("drift", "0", "1")], "kind string, `from` string, `to` string")
    lines = [r["l"] for r in changes.select(codecs.change_text(F.struct("*")).alias("l")).collect()]
    assert lines == ["band: was clean and is mixed", "rating: from 4.0 to 3.5", "reviews: from 1,200 to 40", "bursts: from 10 to 25 percent of the reviews", "the reviews have turned to another product"]
    watched = spark.createDataFrame([("p", 3, T0)], "product_key string, checks int, saved_at timestamp")
    got = {r["product_key"]: (r["watched"], r["checks"]) for r in codecs.watch_status(spark.createDataFrame([("p",), ("q",)], "product_key string"), watched).collect()}
    assert got == {"p": (True, 3), "q": (False, 0)}
    names = spark.range(1).select(*codecs.split_imputed(F.array(F.lit("lift"), F.lit("burst_count"), F.lit("burst_fraction")), ["verificationConcentration"])).first()
    assert list(names) == [["arrival timing"], ["verification pattern"]]


def test_lookup(spark):
    ids = [(1, f"u{i}") for i in range(90)] + [(2, "u1"), (2, None), (3, None)]
    frame = spark.createDataFrame(ids, "listing_id long, reviewer_id string")
    asked = lookup.requests(frame, "salt").cache()
    rows = asked.collect()
    assert {r["listing_id"]: sum(x["listing_id"] == r["listing_id"] for x in rows) for r in rows} == {1: 8, 2: 1, 3: 1}
    assert asked.where(lookup.valid_request(F.col("prefixes"))).count() == 10
    real = {r["prefix"] for r in lookup.prefixes_of(frame.where("listing_id = 1"), "salt", "listing_id").collect()}
    assert all(1 <= len(real & set(r["prefixes"])) <= 9 for r in rows if r["listing_id"] == 1)
    assert rows == lookup.requests(frame, "salt").collect() or sorted(map(str, rows)) == sorted(map(str, lookup.requests(frame, "salt").collect()))
    flags = frame.where("reviewer_id IN ('u1', 'u5')").select(T.salted(F.col("reviewer_id"), "salt").alias("reviewer_hash")).distinct()
    found = {(r["listing_id"], r["reviewer_id"]) for r in lookup.flagged_of(frame, flags, "salt").collect()}
    assert (2, "u1") in found and found <= {(1, "u1"), (1, "u5"), (2, "u1")}
    assert lookup.flagged_of(frame, flags, "salt", answered=F.lit(False)).count() == 0
    one = spark.createDataFrame([(["0000"] * 32,), ([f"{i:04x}" for i in range(31)],), ([f"{i:04X}" for i in range(10, 42)],), ([f"{i:04x}" for i in range(32)],), (None,)], "p array<string>")
    assert [r["v"] for r in one.select(lookup.valid_request(F.col("p")).alias("v")).collect()] == [False, False, False, True, False]
    assert spark.range(5).where(lookup.in_budget(F.col("id"), F.lit(3000))).count() == 4


def test_contribution(spark):
    rows = [(1, 5.0, "Nice", dt.date(2026, 1, 8), None, True, "u"), (1, 4.5, "x", dt.date(2026, 1, 8), None, True, "u"), (1, 5.0, "", dt.date(2026, 1, 8), "month", True, "u"), (1, 5.0, None, None, None, True, "u"), (1, 5.0, None, dt.date(2026, 1, 8), "day", None, "v"), (1, 6.0, None, dt.date(2026, 1, 8), None, None, "v"), (1, 3.0, None, dt.date(2026, 1, 8), None, None, None)]
    reviews = spark.createDataFrame(rows, "listing_id long, rating double, text string, review_date date, date_precision string, verified boolean, reviewer_id string")
    got = lookup.contribution_edges(reviews, "s", signature=True).collect()
    assert [(r["star_rating"], r["week_bucket"], r["verified"], len(r["minhash_signature"])) for r in got] == [(5, 2923, True, 128), (5, 2923, None, 0)]
    assert got[0]["reviewer_hash"] == __import__("hashlib").sha256(b"us").hexdigest()


MODEL = model.Model(-1.0, {"injected_share": 2.0, "lift": 0.5}, [], {"lift": [0.0, 1.0, 2.0]})


def _document(features, probability, version=2, **more):
    return json.dumps({"documentVersion": version, "title": "t", "report": {"probability": probability, "band": "mixed", "serial": "x"}, "features": features, **more})


def test_disputes(spark):
    right = 1 / (1 + math.exp(-(-1 + 2 * 0.4 + 0.5 * 1.0)))
    full = {"ratingDeconvolution.injectedShare": 0.4, "verificationConcentration.lift": None}
    graph = model.Model(0.0, {"flagged_review_share": 1.0}, [], {})
    rows = [
        (1, _document(full, right)),
        (2, _document(full, right + 0.01)),
        (3, _document(full, right, version=1)),
        (4, _document({}, right)),
        (5, _document(full, None)),
        (6, _document({"verificationConcentration.lift": 1.0}, right)),
        (7, _document(full, right, version=9)),
        (8, "{"),
        (9, _document({**full, "reviewerGraph.flaggedReviewShare": 0.0}, 0.5)),
        (10, _document({"temporalBurst.burstCount": 1.0}, 0.5)),
    ]
    got = {r["id"]: r for r in evaluate.reproduce(spark.createDataFrame(rows, "id int, document string"), model.Slots(MODEL, graph)).collect()}
    assert [i for i in got if got[i]["agrees"]] and {i for i in got if got[i]["agrees"]} == {1, 9}
    assert got[9]["slot"] == "reviewerGraph" and got[1]["slot"] == "local" and math.isclose(got[2]["difference"], -0.01)
    assert all(got[i]["problem"] and got[i]["probability"] is None for i in (3, 4, 5, 6, 7, 8, 10)) and got[1]["problem"] is None
    with pytest.raises(ValueError):
        evaluate.reproduce(spark.createDataFrame(rows, "id int, document string"), model.Slots())


def test_audit(spark):
    rows = [(i, 1.0 if i < 10 else 0.0, 1.0, int(i < 10), "d1" if i else "d2") for i in range(20)] + [(20, None, 1.0, 1, "d1")]
    examples = spark.createDataFrame(rows, "id int, injected_share double, lift double, label int, priors string")
    fitted = model.Model(-3.0, {"injected_share": 6.0, "lift": 0.0}, [(0.1, 0.0), (0.9, 1.0)], {})
    row = evaluate.audit(examples, model.Slots(fitted), digest="d1", known={"d1"}).first()
    assert (row["evaluated"], row["skipped"], row["precision"], row["recall"], row["ece"]) == (20, 1, 1.0, 1.0, 0.0)
    assert row["problems"] == [] and row["corpus_priors"] == ["d1", "d2"] and not row["priors_match"]
    old = evaluate.audit(examples, model.Slots(fitted), digest="d0", known={"d1", "d2"}).first()
    assert len(old["problems"]) == 1 and old["priors_match"]
    document = json.loads(evaluate.method_document(evaluate.audit(examples, model.Slots(fitted), digest="d1", known={"d1"}), fitted, F.lit(1.5), 21).first()["document"])
    assert document["criteria"]["met"] and document["coefficients"] == {"injected_share": 6.0, "lift": 0.0} and document["accuracy"]["heldOutCount"] == 21
    assert json.loads(evaluate.absent_document("none"))["published"] is False
    for slots, slot, table in ((model.Slots(), "local", examples), (model.Slots(fitted), "reviewerGraph", examples), (model.Slots(fitted), "odd", examples), (model.Slots(fitted), "local", examples.where("false"))):
        with pytest.raises(ValueError):
            evaluate.audit(table, slots, slot)


def test_featurise(spark):
    review = lambda i: {"rating": float(1 + i % 5), "text": f"text {i}", "date": dt.date(2026, 1, 1) + dt.timedelta(days=i), "date_precision": None, "verified": True, "reviewer_id": f"u{i}"}
    schema = "fixture string, product struct<title: string, category: string>, reviews array<struct<rating: double, text: string, date: date, date_precision: string, verified: boolean, reviewer_id: string>>"
    read = spark.createDataFrame([("a", {"title": "Kettle", "category": "Home"}, [review(i) for i in range(40)]), ("b", {"title": "Cup", "category": None}, [review(1)]), ("c", None, [])], schema)
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 1)], "fixture string, label int")
    priors = spark.createDataFrame([("a", "home")], "fixture string, priors_key string")
    examples, skipped = evaluate.featurise(labels, read, priors)
    row = examples.first()
    assert examples.count() == 1 and (row["fixture"], row["label"], row["priors_key"]) == ("a", 1, "home") and len(row["example_id"]) == 16
    assert row["injected_share"] is not None and row["duplicate_review_share"] is not None and row["flagged_review_share"] is None
    assert {r["fixture"]: r["reason"] for r in skipped.collect()}.keys() == {"b", "c", "d"}
    counts = {(r["by"], r["value"]): r["n"] for r in evaluate.corpus_counts(examples, "label", "priors_key").collect()}
    assert counts == {("label", "1"): 1, ("priors_key", "home"): 1}
    with pytest.raises(ValueError):
        evaluate.paired(read.select("fixture"), labels.where("fixture <> 'a'"))
    assert evaluate.paired(read.select("fixture"), labels.where("fixture <> 'd'")).count() == 3
    aliases = spark.createDataFrame([("x", "home"), ("y", "x"), ("z", "gone")], "alias string, target string")
    assert [r["alias"] for r in evaluate.dangling_aliases(aliases, spark.createDataFrame([("home",)], "key string")).collect()] == ["z"]


def test_canary_run(spark):
    registry = sites.registry(spark, SITES)
    targets = spark.createDataFrame([("shop", "com", "https://www.shop.com/dp/ab1234", 3), ("shop", "de", "https://www.shop.com/dp/ab1234", 3), ("shop", "com", "http://www.shop.com/dp/ab1234", 3), ("shop", "com", "https://www.shop.com/nothing", 3), ("shop", "com", "https://www.shop.com/dp/ab1234", 0), (None, "com", "https://www.shop.com/dp/ab1234", 3)], "site string, locale string, url string, minimum int")
    problems = [r["problem"] for r in canary.target_problems(targets, registry).orderBy(F.col("problem").asc_nulls_first()).collect()]
    assert problems[0] is None and len(problems) == 6 and all(problems[1:]) and len(set(problems)) == 6
    reading = lambda h: [("title", h, 0 if h == "primary" else 1, 2, "selector", None)]
    shape = f"check_id long, {canary.CHECK.replace('status string, ', '')}, minimum int"
    make = lambda *rows: canary.checked(spark.createDataFrame([(i, "shop", loc, "u", T0 + dt.timedelta(days=i), n, 7, err, reading(h), 5) for i, loc, n, err, h in rows], shape))
    old = make((1, "com", 9, None, "primary"), (2, "com", 9, None, "primary"), (3, "de", 9, None, "primary"))
    new = make((4, "com", 2, None, "last-resort"), (5, "de", 9, "gone", "primary"))
    run = canary.run_once(new, old, retained=2)
    assert sorted(r["check_id"] for r in run["combined"].collect()) == [2, 3, 4, 5]
    assert [(r["locale"], r["was"], r["now"], r["direction"]) for r in run["changes"].collect()] == [("com", "healthy", "degraded", "broke"), ("de", "healthy", "failed", "broke")]
    assert [(r["locale"], r["field"], r["was"], r["now"]) for r in run["reading_changes"].collect()] == [("com", "title", "primary", "last-resort")]
    lines = canary.history_json(run["combined"])
    back = canary.read_history(lines)
    assert back.count() == 4 and back.where("status = 'failed'").first()["error"] == "gone" and back.first()["readings"][0]["tiers"] == 2
    for bad in ('{"historyVersion": 2, "site": "s"}', '{"historyVersion": 1, "site": "s"}', "no"):
        with pytest.raises(ValueError):
            canary.read_history(spark.createDataFrame([(bad,)], "document string"))
    status = json.loads(canary.status_document(run["current"], F.lit(1)).first()["document"])
    assert status["documentVersion"] == 1 and [r["status"] for r in status["rows"]] == ["degraded", "failed"]
    cut = json.loads(spark.createDataFrame([("x" * 3000,)], "m string").select(canary.payload(F.col("m")).alias("p")).first()["p"])
    assert len(cut["text"]) == 3000 and len(cut["content"]) == 2000 and cut["content"].endswith("…")
    judged = spark.createDataFrame([("a", "de", True, False, []), ("b", "com", False, True, ["title: x"]), ("c", "com", False, False, ["y"])], "page string, locale string, passed boolean, unexpected boolean, problems array<string>")
    assert [r["line"] for r in canary.report_lines(judged).collect()] == ["1 of 3 pages pass", "com 0/2", "de 1/1", "b: title: x", "c [known]: y"]
    with pytest.raises(ValueError):
        canary.run_once(new, old, 0)


def test_previous_checks(spark):
    entries = spark.createDataFrame([(1, T0, "p"), (2, T0 + dt.timedelta(days=1), "p"), (3, T0 + dt.timedelta(days=2), "q")], "id long, at timestamp, product_key string")
    assert [r["id"] for r in history.previous(entries, "p", F.lit(str(T0 + dt.timedelta(days=1))).cast("timestamp")).collect()] == [1]
