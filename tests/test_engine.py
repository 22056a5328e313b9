"""The engine's own operators on small literals with known answers."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import stats, urls
from reviewlens.functions import text as T
from reviewlens.operators import canary, graph, history, model, report, signals
from reviewlens.sources import jsonpath
from reviewlens.streaming import ingest

REVIEW = "listing_id long, review_id long, rating double, text string, review_date date, date_precision string, verified boolean, reviewer_id string"


def one(spark, column, **values):
    """The value of a column expression over one row of strings or numbers."""
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def quantile(rate, p=0.99):
    """Smallest k whose summed Poisson probabilities reach p."""
    k, total = 0, math.exp(-rate)
    while rate and total < p:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_poisson_quantiles():
    rates = np.array([0, 0.5, 3, 4.5, 17, 64])
    assert stats.poisson_quantiles(rates).tolist() == [quantile(r) for r in rates]
    assert 1000 < stats.poisson_quantiles(np.array([1000.0]))[0] < 1200


def burst_runs(counts):
    """(start, end, reviews) of runs of days that are far above the median of the 28 days before."""
    hit = [False] + [n > quantile(float(np.median(counts[max(0, i - 28) : i]))) for i, n in enumerate(counts) if i]
    runs = []
    for i, h in enumerate(hit):
        if h and i and hit[i - 1]:
            runs[-1][1] = i
            runs[-1][2] += counts[i]
        elif h:
            runs.append([i, i, counts[i]])
    return [tuple(r) for r in runs]


@pytest.mark.parametrize("seed", range(5))
def test_bursts(spark, seed):
    rng = random.Random(seed)
    usual = rng.choice((0, 1, 4, 9))
    counts = [1 + usual] + [max(0, usual + rng.randrange(-2, 3)) if rng.random() < 0.9 else usual * 6 + 7 for _ in range(90)]
    table = spark.createDataFrame([(1, d, n) for d, n in enumerate(counts) if n], "listing_id long, day int, n long")
    runs = burst_runs(counts)
    found = signals.bursts(signals.burst_days(table))
    assert runs and sorted((r["start_day"], r["end_day"], r["review_count"]) for r in found.collect()) == runs
    share = signals.burst_features(table, found).first()
    assert math.isclose(share["burst_fraction"], sum(n for *_, n in runs) / sum(counts)) and math.isclose(share["largest_burst_share"], max(n for *_, n in runs) / sum(counts))
    assert share["burst_count"] == len(runs)


def test_no_bursts(spark):
    table = spark.createDataFrame([(1, 7, 800), *[(2, d, 6) for d in range(50)]], "listing_id long, day int, n long")
    found = signals.bursts(signals.burst_days(table))
    assert found.count() == 0
    assert {tuple(r)[1:] for r in signals.burst_features(table, found).collect()} == {(0.0, 0, 0.0)}


def test_deconvolution(spark):
    rng = np.random.default_rng(3)
    prior, kernel = (0.25, 0.15, 0.1, 0.15, 0.35), (0.1, 0.0, 0.0, 0.2, 0.7)
    axis = np.subtract(kernel, prior)
    shapes = [prior, kernel, tuple(np.add(prior, 0.3 * axis)), tuple(np.add(prior, 1.4 * axis)), tuple(np.subtract(prior, 0.2 * axis)), *map(tuple, rng.dirichlet(np.ones(5), 6))]
    rows = [(i, *map(float, shape)) for i, shape in enumerate(shapes)]
    got = {r["listing_id"]: r for r in signals.rating_deconvolution(spark.createDataFrame(rows, "listing_id long, h1 double, h2 double, h3 double, h4 double, h5 double"), prior, kernel).collect()}
    for i, shape in enumerate(shapes):
        share = float(np.clip(np.linalg.lstsq(axis[:, None], np.subtract(shape, prior), rcond=None)[0][0], 0, 1))
        error = float(np.sqrt(np.mean((np.array(shape) - np.array(prior) - share * axis) ** 2)))
        assert math.isclose(got[i]["injected_share"], share, abs_tol=1e-9) and math.isclose(got[i]["residual_error"], error, abs_tol=1e-9)


def test_lift(spark):
    rng = random.Random(9)
    rows = [(listing, rng.random() < 0.4, rng.choice((5.0, 5.0, 4.0, 4.9)), rng.choice((True, False, False, None))) for listing in range(6) for _ in range(rng.randrange(1, 25))]
    rows += [(7, True, 5.0, True), (8, False, 5.0, False), (9, True, 5.0, None)]
    got = {r["listing_id"]: (r["base"], r["lift"]) for r in signals.verification_lift(spark.createDataFrame(rows, "listing_id long, in_burst boolean, rating double, verified boolean")).collect()}
    for listing in {r[0] for r in rows}:
        known = [r for r in rows if r[0] == listing and r[3] is not None]
        inside = [r for r in known if r[1] and r[2] == 5]
        overall = sum(not r[3] for r in known) / len(known) if known else 0
        lift = sum(not r[3] for r in inside) / len(inside) / overall if inside and overall else None
        assert got[listing][0] == len(inside) and (got[listing][1] is None) == (lift is None) and (lift is None or math.isclose(got[listing][1], lift))


def test_shingles_and_jaccard(spark):
    for text in ("Tea  Kettle,\tred", "abcde", "abcd", "  ", "ÄÖÜ straße 12"):
        folded = " ".join(text.lower().split())
        want = {folded[i : i + 5] for i in range(len(folded) - 4)} if len(folded) > 5 else {folded}
        assert set(one(spark, T.shingles(F.col("t")), t=text)) == want
    for a, b in ((("k", "e", "t"), ("t", "l", "e", "s")), (("x",), ("y",)), (("q", "r"), ("q", "r"))):
        assert one(spark, T.jaccard(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))), t="") == len({*a} & {*b}) / len({*a} | {*b})
    empty = F.array().cast("array<string>")
    assert one(spark, T.jaccard(empty, empty), t="") == 1.0
    words = ["red", "kettle", "4", "5", "l"]
    assert one(spark, T.terms(F.col("t")), t="Red-kettle (4.5 L)") == words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_hashes(spark):
    # a published test vector of the hash
    assert int(one(spark, T.fnv1a64(F.col("t")), t="foobar")) == 0x85944171F73967E8 == T.fnv1a64_of(b"foobar")
    assert T.fnv1a64_many([b"", b"kettle", b"foobar"]).tolist() == [T.fnv1a64_of(b) for b in (b"", b"kettle", b"foobar")]
    rng = np.random.default_rng(1)
    a, h = rng.integers(0, T.MERSENNE, 500, dtype=np.uint64), rng.integers(0, T.MERSENNE, 500, dtype=np.uint64)
    assert T.mulmod(a, h).tolist() == [int(x) * int(y) % T.MERSENNE for x, y in zip(a, h, strict=True)]
    assert one(spark, T.fnv1a32(F.col("t")), t="a") == 0xE40C292C
    assert len(one(spark, T.serial(F.col("t")), t="report")) == 9


def test_near_duplicates(spark):
    one_text, other = "the lid closes tightly and the handle stays cool to the touch", "arrived a week late in a box that had been opened before"
    texts = [(1, one_text), (1, one_text + "!"), (1, other), (1, other), (1, other.upper()), (1, "colour is off"), (1, "too small for a family")] + [(2, "fine")] + [(3, None)]
    got = {r["listing_id"]: (r["duplicate_review_share"], r["cluster_count"], r["largest_cluster_share"]) for r in signals.near_duplicate_features(spark.createDataFrame(texts, "listing_id long, text string")).collect()}
    assert got == {1: (5 / 7, 2, 3 / 7), 2: (0.0, 0, 0.0), 3: (None, None, None)}


def test_change_point():
    rng = np.random.default_rng(4)
    for n, cut in ((12, 6), (40, 9), (33, 28), (11, 5)):
        x = rng.normal(0, 0.2, (n, 4)) + np.where(np.arange(n)[:, None] < cut, [1.0, 0, 0, 0], [0, 0, 1.0, 0])
        best = (-1, 0.0)
        for k in range(5, n - 4) if n >= 12 else ():
            a, b = x[:k].sum(axis=0), x[k:].sum(axis=0)
            distance = 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
            if distance > best[1]:
                best = (k, distance)
        split, distance = signals.change_point_of(x)
        assert split == best[0] and math.isclose(distance, best[1], abs_tol=1e-12)


def test_overlap_pvalue():
    for n, a, b, k in ((12, 5, 4, 2), (30, 7, 9, 5), (8, 8, 3, 3), (50, 1, 1, 1), (20, 6, 6, 0)):
        tail = sum(math.comb(a, x) * math.comb(n - a, b - x) for x in range(k, min(a, b) + 1)) / math.comb(n, b)
        assert math.isclose(stats.overlap_pvalue_of(n, a, b, k), tail if k else 1.0)


def test_sanitise_and_caps(spark):
    rng = random.Random(5)
    t = dt.datetime(2026, 1, 1)
    rows = [(f"r{rng.randrange(6)}", f"p{rng.randrange(7)}", rng.choice((4, 5, 5, 5)), 1, rng.choice((None, None, True)), t + dt.timedelta(minutes=i)) for i in range(60)]
    rows += [("busy", f"p{i:02}", 5, 1, True, t + dt.timedelta(minutes=i)) for i in range(33)]
    edges = spark.createDataFrame(rows, "reviewer_hash string, product_hash string, star_rating int, week_bucket int, verified boolean, received_at timestamp")
    claims = {}
    for r, p, *claim, at in rows:
        claims.setdefault((r, p), []).append((at, tuple(claim)))
    single = {pair: min(at for at, _ in seen) for pair, seen in claims.items() if len({c for _, c in seen}) == 1}
    kept, dropped = graph.sanitise(edges)
    assert {(r["reviewer_hash"], r["product_hash"]): r["received_at"] for r in kept.collect()} == single
    conflicts = sum(len(seen) for pair, seen in claims.items() if pair not in single)
    assert dropped.agg(F.sum("conflicts"), F.sum("duplicates")).first()[:] == (conflicts, len(rows) - conflicts - len(single)) and conflicts
    for most_products, most_reviewers in ((12, 5000), (4, 3), (500, 2)):
        by_r, by_p, want = {}, {}, set()
        for (r, p), at in sorted(single.items(), key=lambda x: (x[1], *x[0])):
            if by_r.get(r, 0) < most_products and by_p.get(p, 0) < most_reviewers:
                by_r[r], by_p[p] = by_r.get(r, 0) + 1, by_p.get(p, 0) + 1
                want.add((r, p))
        assert {(r["reviewer_hash"], r["product_hash"]) for r in graph.cap_degrees(kept, most_products, most_reviewers).collect()} == want


def test_communities(spark):
    ring = lambda tag, n: [(f"{tag}{i}", f"{tag}{j}", 2.0) for i in range(n) for j in range(i + 1, n)]
    edges = spark.createDataFrame([*ring("k", 4), *ring("m", 7), *ring("z", 3), ("k1", "m2", 0.2)], "a string, b string, weight double")
    parts = {r["node"]: r["community"] for r in graph.communities(edges).collect()}
    assert parts == {f"{tag}{i}": f"{tag}0" for tag, n in (("k", 4), ("m", 7), ("z", 3)) for i in range(n)}
    assert graph.connected(edges.select("a", "b")).select("comp").distinct().count() == 2


def test_disparity(spark):
    for share, degree in ((0.5, 4), (0.25, 9), (0.9, 2)):
        assert math.isclose(one(spark, stats.disparity_alpha(F.col("s"), F.col("k")), s=share, k=degree), (1 - share) ** (degree - 1))
    assert one(spark, stats.disparity_alpha(F.col("s"), F.col("k")), s=0.3, k=1) == 0.0


def test_model(spark):
    m = model.Model(0.0, {"x": 1.0, "y": 2.0}, [(0.0, 0.1), (1.0, 0.9)], {"x": [0.0, 2.0]})
    assert model.Model.from_json(m.to_json()) == m
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 1.0, None), (4, None, None)], "listing_id long, x double, y double")
    got = {r["listing_id"]: r for r in model.score(rows, m).collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["ok", "ok", "missing-features", "insufficient-data"]
    assert math.isclose(got[1]["probability"], 0.5) and got[2]["imputed"] == ["x"] and got[3]["probability"] is None
    with pytest.raises(ValueError):
        model.Slots().place("graph", m)
    with pytest.raises(ValueError):
        model.Model.from_json(m.to_json().replace("0.9", "NaN"))


def test_isotonic_and_fit(spark):
    ys = [0, 3, 2, 2, 5, 1, 6, 6, 4]
    pooled = [max(min(sum(ys[j : k + 1]) / (k + 1 - j) for k in range(i, len(ys))) for j in range(i + 1)) for i in range(len(ys))]
    assert np.allclose([y for _, y in model.isotonic(list(enumerate(ys)))], pooled)
    rows = spark.createDataFrame([(float(i % 10) / 10, int(i % 10 > 4)) for i in range(200)], "x double, label int")
    bias, weights = model.fit_logistic(rows, ["x"], penalty=0.0)
    assert weights["x"] > 3 and bias < 0


def test_band(spark):
    assert [one(spark, stats.band(F.col("p")), p=p) for p in (0.0, 0.2, 0.55, 0.99, 1.0)] == ["clean", "mostly-clean", "mixed", "heavily-manipulated", "heavily-manipulated"]


def test_jsonpath():
    doc = {"shelf": [{"kind": "cup", "n": 4}, {"kind": ["bowl", "cup"], "n": 7}, {"n": 9}], "n": 1}
    run = lambda p: jsonpath.evaluate(doc, jsonpath.parse(p))
    assert run("$..[?(@.kind=='cup')].n") == [4, 7]
    assert run("$.shelf[?(@.kind!='cup')].n") == [9]
    assert run("$.shelf[*].n") == [4, 7, 9] and run("$.shelf[-1].n") == [9] and run("$['shelf'][0].n") == [4] and run("$..n") == [1, 4, 7, 9]
    assert run("$.shelf[?(@.kind)].n") == [4, 7] and run("$.none") == []
    assert jsonpath.parse("$.shelf[?(@.n >= 5)]") is None and jsonpath.parse("shelf") is None


def test_numbers(spark):
    cases = [("12,907 sold", "com", 12907.0), ("3,7", "de", 3.7), ("3.7", "es", 3.0), ("~ 45,67,890", "in", 4567890.0), ("45,67,890", "co.uk", 45.0), ("x", "com", None), ("5", "nowhere", None), ("1.234,5 €", "fr", 1234.5), ("1\u202f234,5", "pl", 1234.5), ("-3.5", "com", -3.5), ("1 234", "com", 1234.0)]
    for raw, locale, want in cases:
        assert one(spark, urls.number(F.col("r"), F.col("l")), r=raw, l=locale) == urls.read_number(raw, locale) == want, raw


def test_history(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(i, t + dt.timedelta(days=i), f"t{i}", "p" if i < 3 else None, "mixed", 4.0, 3.5) for i in range(5)]
    entries = spark.createDataFrame(rows, "id long, at timestamp, title string, product_key string, band string, claimed double, adjusted double")
    assert sorted((r["id"], r["n"]) for r in history.grouped(entries).collect()) == [(2, 3), (3, 1), (4, 1)]
    merged, counts = history.import_entries(entries.where("id < 3"), entries, 4)
    assert counts.first()[:] == (2, 3, 0, 0) or counts.first()["added"] == 2
    assert merged.count() == 4
    assert one(spark, T.csv_field(F.col("v")), v='=1,"x') == '"\'=1,""x"'


def test_rate_limit(spark):
    rows = spark.createDataFrame([("o", float(t)) for t in (0, 1, 2, 3, 61)], "origin string, at double")
    assert [r["allowed"] for r in ingest.limit_rate(rows, 2, 60.0).orderBy("at").collect()] == [True, True, False, False, True]


def test_stream_equals_batch(spark, tmp_path):
    import json

    folder = tmp_path / "in"
    folder.mkdir()
    edge = lambda b, r, v: {"batch_id": b, "reviewer_hash": r * 64, "product_hash": "0" * 64, "star_rating": 5, "week_bucket": 10, "verified": v, "minhash_signature": [], "received_at": "2026-01-01T00:00:00"}
    rows = [edge("x", "a", None), edge("x", "a", None), edge("x", "b", True), edge("y", "z", True), edge("y", "c", True)]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    ingest.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r[0][0] for r in spark.read.parquet(str(tmp_path / "out")).select("reviewer_hash").collect()) == ["a", "b"]
    origins = tmp_path / "req"
    spark.createDataFrame([("o", float(t)) for t in (0, 1, 2, 3, 61)], "origin string, at double").coalesce(1).write.parquet(str(origins))
    stream = spark.readStream.schema("origin string, at double").parquet(str(origins))
    q = ingest.limit_rate(stream, 2, 60.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["allowed"] for r in spark.table("limited").orderBy("at").collect()] == [True, True, False, False, True]


def test_adjusted_rating(spark):
    rows = spark.createDataFrame([(1, float(r)) for r in (5, 5, 5, 2, 1)], "listing_id long, rating double")
    got = report.adjusted_rating(rows, spark.createDataFrame([(1, 0.4)], "listing_id long, injected_share double")).first()
    assert (got["excluded"], got["claimed"]) == (2, 3.6) and math.isclose(got["adjusted"], 8 / 3)


def test_registry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
