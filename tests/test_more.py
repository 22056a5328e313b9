"""Embeddings, notices, artifacts, labelling functions and training on small literals."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import embedding
from reviewlens.functions import text as T
from reviewlens.operators import model, notices, signals
from reviewlens.sources import files


def test_backends(spark):
    tokens, vectors = ["cat", "dog", "anti"], np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    lexicon = embedding.backend(files.build_lexicon(tokens, vectors))
    assert isinstance(lexicon, embedding.Lexicon) and lexicon.identity == "lexicon-3x2" and lexicon.dimensions == 2
    for broken in (None, b"", files.build_lexicon(tokens, vectors)[:-1], b"x" * (embedding.MAX_BYTES + 1)):
        assert isinstance(embedding.backend(broken), embedding.HashedTerms)
    texts = spark.createDataFrame([(1, "Cat cat, dog!"), (2, "cat anti"), (3, "bird"), (4, None), (5, "dog")], "id int, text string")
    got = {r["id"]: r["v"] for r in texts.select("id", lexicon.embed(F.col("text")).alias("v")).collect()}
    assert np.allclose(got[1], np.array([2, 1]) / np.sqrt(5)) and got[2] is None and got[3] is None and got[4] is None and got[5] == [0.0, 1.0]
    table = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in zip(tokens, vectors, strict=True)], "token string, vec array<double>")
    joined = {r["id"]: r["v"] for r in embedding.embed_by_table(texts, table, "id").collect()}
    assert set(joined) == {1, 5} and all(np.allclose(joined[i], got[i]) for i in joined)
    hashed = texts.select(embedding.HashedTerms().embed(F.col("text")).alias("v")).first()["v"]
    assert len(hashed) == 256 and np.isclose(np.linalg.norm(hashed), 1)


def test_policy(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    changes = spark.createDataFrame([(1, 1, day(1), "a"), (2, 3, day(9), "b"), (3, 3, day(5), " ")], "place int, version int, effective_at timestamp, summary string")
    assert [(r["place"], r["problem"]) for r in notices.change_problems(changes).orderBy("place", "problem").collect()] == [(3, "it says nothing"), (3, "it takes effect before the one before it"), (3, "the version doesn't rise")]
    assert [r["version"] for r in notices.pending_changes(changes, 1).collect()] == [3, 3]
    at = lambda d: F.lit(str(day(d))).cast("timestamp")
    assert notices.headline(changes, at(7)).first()[0] == "the policy will change" and notices.headline(changes, at(20)).first()[0] == "the policy has changed"
    assert notices.headline(changes.where("false"), at(7)).first()[0] is None


def test_published_figures(spark):
    times = spark.createDataFrame([("a", 100.0), ("a", 1400.0), ("a", 1600.0), ("b", 1500.0)], "label string, ms double")
    got = {r["label"]: (r["median_ms"], r["worst_ms"], r["within_budget"], r["headroom_ms"]) for r in notices.time_verdict(times).collect()}
    assert got == {"a": (1400.0, 1600.0, True, 100.0), "b": (1500.0, 1500.0, False, 0.0)}
    samples = spark.createDataFrame([("hits", "counter", "Hits.", {"path": 'a"b'}, 3.0), ("hits", "counter", "Hits.", {}, 4.0), ("edges", "gauge", "Held.", {}, 1.0)], "name string, kind string, help string, labels map<string,string>, value double")
    assert [r["line"] for r in notices.metrics_text(samples).collect()] == ["# HELP edges Held.", "# TYPE edges gauge", "edges 1.0", "# HELP hits Hits.", "# TYPE hits counter", "hits 4.0", 'hits{path="a\\"b"} 3.0']


def test_load(spark):
    load = notices.synthetic_reviews(spark, 300, 2)
    rows = load.collect()
    assert rows == notices.synthetic_reviews(spark, 300, 2).collect() and len(rows) == 600
    first = [r for r in rows if r["listing_id"] == 0]
    assert 40 < 300 - len({r["text"] for r in first}) < 80 and all(len(r["text"].split()) == 40 for r in first)
    assert 0.6 < sum(r["verified"] for r in first) / 300 < 0.8 and {r["rating"] for r in first} == {1.0, 2.0, 3.0, 4.0, 5.0}
    assert signals.minimum_data(load).where("meets_minimum").count() == 2


def test_artifact(spark):
    a = model.Model(0.5, {"lift": 1.0}, [(0.1, 0.2), (0.9, 0.8)], {"lift": [0.0, 1.0]})
    text = model.absent_artifact("not trained")
    assert model.read_artifact(text) is None and model.artifact_priors(text) == {}
    with pytest.raises(ValueError):
        model.place_in_artifact(text, "reviewerGraph", a, 1.0, {}, "d")
    text = model.place_in_artifact(text, "local", a, 1.0, {"met": True}, "d1")
    assert model.read_artifact(text) == model.Slots(a, None)
    text = model.place_in_artifact(text, "reviewerGraph", model.Model(0.0, {"x": 1.0}), 2.0, {}, "d2")
    text = model.place_in_artifact(text, "local", a, 3.0, {}, "d3")
    assert model.read_artifact(text).graph == model.Model(0.0, {"x": 1.0}) and model.artifact_priors(text) == {"local": "d3", "reviewerGraph": "d2"}
    whole = json.loads(text)
    for broken in ({**whole, "artifactVersion": 2}, {k: v for k, v in whole.items() if k != "intercept"}, {**whole, "calibration": [{"x": 0.5, "y": 1}, {"x": 0.1, "y": 2}]}, {**whole, "featureQuantiles": {"lift": [2.0, 1.0]}}):
        with pytest.raises(ValueError):
            model.read_artifact(json.dumps(broken))
    with pytest.raises(ValueError):
        model.place_in_artifact(text, "odd", a, 1.0, {}, "d")
    assert model.document_digest({"b": 1, "a": [1, 2]}) == model.document_digest({"a": [1, 2], "b": 1}) and len(model.document_digest({})) == 8
    document = {"categories": {"home": {"organicPrior": [0.1, 0.1, 0.2, 0.3, 0.3]}}, "aliases": {"house": "home"}}
    priors, aliases = model.read_priors(spark, json.dumps(document))
    assert priors.first()["kernel"] == list(signals.INJECTION_KERNEL) and aliases.first()[:] == ("house", "home")
    with pytest.raises(ValueError):
        model.read_priors(spark, json.dumps({"categories": {"x": {"organicPrior": [1, 1, 1, 1, 1]}}}))


def test_labelling_functions(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 2)], "id int, n int")
    voted = model.python_votes(rows, {"big": lambda r: int(r["n"] > 3), "odd": lambda r: 7, "broken": lambda r: 1 / 0}, "id")
    got = {(r["id"], r["lf"]): r["vote"] for r in voted.collect()}
    assert got[1, "big"] == 1 and got[3, "big"] == 0 and all(v == -1 for (_, lf), v in got.items() if lf != "big")


def test_isotonic_of_ranges(spark):
    rng = np.random.default_rng(60)
    x = np.round(rng.random(400), 3)
    points = [(float(a), float(rng.random() < a)) for a in x]
    table = spark.createDataFrame(points, "raw double, label double")
    want = dict(model.isotonic(points))
    for ranges in (1, 7, 1024):
        curve = model.isotonic_table(table, ranges=ranges)
        assert all(np.isclose(want[a], b) for a, b in curve)
        xs, ys = zip(*curve, strict=True)
        assert np.allclose(np.interp(sorted(want), xs, ys), [want[a] for a in sorted(want)])


def test_split_is_exact(spark):
    rows = spark.range(1000).withColumnRenamed("id", "example_id")
    for fraction in (0.0, 0.001, 0.2, 1.0):
        got = model.split(rows, fraction, 3)
        assert got.where("is_test").count() == round(1000 * fraction)
    hashes = {r["example_id"]: __import__("hashlib").sha256(f"3:{r['example_id']}".encode()).hexdigest() for r in rows.collect()}
    assert {r["example_id"] for r in model.split(rows, 0.2, 3).where("is_test").collect()} == set(sorted(hashes, key=hashes.get)[:200])


def test_fit_is_bounded(spark):
    rng = np.random.default_rng(61)
    x = rng.standard_normal(500)
    rows = spark.createDataFrame([(float(a), int(rng.random() < 1 / (1 + np.exp(-2 * a)))) for a in x], "x double, label int")
    _, whole = model.fit_logistic(rows, ["x"], penalty=0.0)
    _, part = model.fit_logistic(rows, ["x"], penalty=0.0, most=250)
    assert 1.5 < whole["x"] < 2.6 and 1.2 < part["x"] < 3.2
    assert model.fit_logistic(rows.where("false"), ["x"]) == (0.0, {"x": 0.0})


def test_category_slugs(spark):
    trail = spark.createDataFrame([("Ｂooks＞x > ﬁction & Fun",)], "t string").select(T.category_keys(F.col("t")).alias("k")).first()["k"]
    assert trail == ["fiction-fun", "books-x"]


def test_command_line(spark, tmp_path, capsys):
    from reviewlens.__main__ import main

    assert main(["list"]) == 0 and "score_listings" in capsys.readouterr().out
    spark.createDataFrame([(i, i % 3 == 0) for i in range(9)], "a int, b boolean").write.parquet(str(tmp_path / "t"))
    assert main(["run", "nothing", str(tmp_path)]) == 1
    names = ("ratingDeconvolution.injectedShare", "verificationConcentration.lift")
    fitted = model.Model(-3.0, {names[0]: 6.0}, [(0.1, 0.0), (0.9, 1.0)], {})
    (tmp_path / "m.json").write_text(model.place_in_artifact(model.absent_artifact("x"), "local", fitted, 1.0, {}, "d"))
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"exampleId": str(i), "features": {names[0]: float(i < 5), names[1]: None}, "label": int(i < 5), "metadata": {"priors": "d"}}) + "\n" for i in range(10)))
    assert main(["audit", str(tmp_path / "m.json"), str(tmp_path / "c.jsonl"), "--priors", "d"]) == 0
    assert "evaluated: 10" in capsys.readouterr().out
    assert main(["audit", str(tmp_path / "m.json"), str(tmp_path / "c.jsonl")]) == 1
    document = {"documentVersion": 2, "report": {"probability": 1.0}, "features": {names[0]: 1.0}}
    (tmp_path / "d.jsonl").write_text(json.dumps(document) + "\n")
    assert main(["dispute", str(tmp_path / "m.json"), str(tmp_path / "d.jsonl")]) == 0 and "agrees" in capsys.readouterr().out
    (tmp_path / "n.json").write_text(model.absent_artifact("x"))
    assert main(["dispute", str(tmp_path / "n.json"), str(tmp_path / "d.jsonl")]) == 1


def test_short_digests(spark):
    def plain(t):
        h = 0x811C9DC5
        data = t.encode("utf-16-le")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return h

    texts = ["", "a", "naïve", "🙂 two units", "日本", None, "x" * 300]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.fnv1a32(F.col("t")).alias("h"), T.serial(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["h"] for r in rows] == [None if t is None else plain(t) for t in texts]
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n, out = plain("a"), ""
    while n:
        n, d = divmod(n, 36)
        out = digits[d] + out
    assert rows[1]["s"] == f"{out.rjust(8, '0')[:4]}-{out.rjust(8, '0')[4:]}"


def test_refined_and_sizes(spark):
    from reviewlens.operators import graph, report

    first = spark.createDataFrame([(1, 0.1), (2, 0.2)], "listing_id int, p double")
    later = spark.createDataFrame([(2, 0.9)], "listing_id int, p double")
    assert sorted(map(tuple, report.refined(first, later).collect())) == [(1, 0.1, True), (2, 0.9, False)]
    parts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", "w")], "node string, community string")
    assert [tuple(r) for r in graph.by_size(parts).collect()] == [("y", 2), ("w", 1), ("x", 1)]


def test_change_points_in_ranges(spark):
    rng = np.random.default_rng(70)
    rows = []
    for listing, n in ((1, 60), (2, 11), (3, 40), (4, 30)):
        for i in range(n):
            centre = np.array([1.0, 0, 0]) if listing != 3 and i < n // 2 else np.array([0, 1.0, 0])
            rows.append((listing, int(20000 + (i if listing == 1 else i // 10)), len(rows), [float(x) for x in centre + rng.normal(0, 0.1, 3)]))
    frame = spark.createDataFrame(rows, "listing_id long, day long, review_id long, v array<double>")
    for ranges in (1, 7, 64):
        got = {r["listing_id"]: r for r in signals.change_points(frame, "listing_id", ["day", "review_id"], "v", ranges).collect()}
        for listing in (1, 2, 3, 4):
            own = sorted(r[1:] for r in rows if r[0] == listing)
            split, distance = signals.change_point_of(np.array([v for *_, v in own]))
            r = got[listing]
            assert r["n"] == len(own) and abs(r["drift_statistic"] - distance) < 1e-9
            told = distance >= 0.5
            assert (r["split"], r["at"], r["after"]) == ((split, own[split][0], len(own) - split) if told else (None, None, None)), (ranges, listing)


def test_hashed_terms_in_flat_arrays(spark):
    texts = ["Red kettle, red KETTLE 4", "", None, "日本語 naïve 🙂 x", "a", "b " * 3000, "…"]
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "i int, t string, r string")
    rows = T.with_hashed_terms(frame, "t", "h").select("i", "r", "h", T.hashed_terms(T.terms(F.col("t"))).alias("want")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["h"] == r["want"] and r["r"] == "k", texts[r["i"]]
