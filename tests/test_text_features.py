"""Queries with text signals over small tables, against brute force."""

import datetime as dt
import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
from reviewlens.functions import text as T
from reviewlens.operators import report, signals

DOCS = 8


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of 8 documents and 64 events of four listings; one document is another's but for case and blanks, one is null."""
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(30)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(60)) for _ in range(DOCS - 2)]
    texts += [texts[0].upper().replace(" ", "  "), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    rows = []
    for i in range(64):
        user = (0, 1, 7, 50)[rng.randrange(4)]
        rows.append((i, dt.datetime(2026, 1, 1 + rng.randrange(28)), user, ("view", "purchase", "error", "signup")[rng.randrange(4)]))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(path / "events.parquet"))
    return str(path), texts, rows


def _hashed(text):
    tokens = re.findall(r"[^\W_]+", (text or "").lower())
    out = np.zeros(T.DIMENSIONS)
    for t in [*tokens, *map(" ".join, zip(tokens, tokens[1:]))]:
        h = T.fnv1a64_of(t.encode())
        out[h % T.DIMENSIONS] += -1 if h >> 63 else 1
    return out


def _cosine(a, b):
    return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)


def _brute(texts, rows, listing):
    """Duplicate share, clusters, largest cluster share, off-topic share, mean distance, drift."""
    own = [(ts.date(), i, texts[i % DOCS]) for i, ts, user, _ in rows if user == listing]
    copies = Counter(" ".join(t.lower().split()) for _, _, t in own if t)
    total, big = sum(copies.values()), [c for c in copies.values() if c > 1]
    product = _hashed(texts[listing]) if listing < DOCS else np.zeros(T.DIMENSIONS)
    distances = [1 - _cosine(_hashed(t), product) for _, _, t in own if t] if product.any() else []
    line = [_hashed(t) for _, i, t in sorted(own, key=lambda x: x[:2]) if t and i % 11]
    line = [v / np.sqrt(v @ v) for v in line]
    n = len(line)
    drift = max([0.0, *(1 - _cosine(sum(line[:k]), sum(line[k:])) for k in range(5, n - 4))]) if n >= 12 else 0.0
    off = sum(d >= 1 for d in distances) / len(distances) if distances else None
    return sum(big) / total, len(big), max(big, default=0) / total, off, np.mean(distances) if distances else None, drift


NAMES = ("duplicate_review_share", "cluster_count", "largest_cluster_share", "off_topic_share", "mean_distance", "drift_statistic")


def test_vectors_and_evidence(spark, folder):
    path, texts, rows = folder
    queries = __spark_entry__.queries()
    vectors = {r["listing_id"]: r for r in queries["feature_vector_texts"](spark, path).collect()}
    evidence = {(r["listing_id"], r["signal"]): r for r in queries["evidence_rows_texts"](spark, path).collect()}
    assert sorted(vectors) == [0, 1, 7, 50] and len(evidence) == 4 * len(report.EVIDENCE)
    for k, v in vectors.items():
        want = _brute(texts, rows, k)
        for name, x in zip(NAMES, want, strict=True):
            assert v[name] == (x if x is None else pytest.approx(x, abs=1e-6)), (k, name)
        for signal, x in (("duplicate text", want[0]), ("different product", want[3])):
            e = evidence[k, signal]
            assert e["value"] == (x if x is None else pytest.approx(x, abs=1e-6)) and (e["strength"] == "none") == (x is None)
    assert all(_brute(texts, rows, k)[0] > 0 for k in vectors) and any(_brute(texts, rows, k)[5] > 0 for k in vectors)


def test_reports_hold_text_evidence(spark, folder):
    path, texts, rows = folder
    got = {r["listing_id"]: json.loads(r["document"]) for r in __spark_entry__.queries()["listing_reports"](spark, path).collect()}
    assert sorted(got) == [0, 1, 7, 50]
    for k, document in got.items():
        values = {e["signal"]: e.get("value") for e in document["evidence"]}
        want = _brute(texts, rows, k)
        assert values["duplicate text"] == pytest.approx(want[0]) and values["different product"] == (want[3] if want[3] is None else pytest.approx(want[3]))


def test_off_topic_reads_whole_products(spark, folder):
    path, texts, rows = folder
    assert all(len(t) > 200 for t in texts if t)
    got = {r["listing_id"]: r for r in __spark_entry__.queries()["off_topic_share"](spark, path).collect()}
    assert sorted(got) == [0, 1, 7]  # listing 50 has no product, and 7's has no text
    for k, r in got.items():
        share, distance = _brute(texts, rows, k)[3:5]
        assert r["n_embedded"] == sum(user == k and texts[i % DOCS] is not None for i, _, user, _ in rows)
        assert (r["off_topic_share"], r["mean_distance"]) == ((None, None) if share is None else (pytest.approx(share), pytest.approx(distance)))


def _interval(rows, listing, resamples=200):
    """Quartiles of the injected share over resamples of a listing's ratings, in order of size."""
    stars = sorted(1 + (i * 7 + user * 3) % 5 for i, _, user, kind in rows if user == listing and kind != "error")
    prior, kernel = np.array(signals.ORGANIC_PRIOR), np.array(signals.INJECTION_KERNEL)
    axis, n, shares = kernel - prior, len(stars), []
    for b in range(resamples):
        drawn = [stars[int(int(hashlib.sha256(f"0:{listing}:{b}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) * n)] for i in range(n)]
        histogram = np.array([drawn.count(k) / n for k in range(1, 6)])
        shares.append(min(1.0, max(0.0, (histogram - prior) @ axis / (axis @ axis))))
    return np.quantile(shares, [0.25, 0.75])


def test_intervals_of_200_resamples(spark, folder):
    path, _, rows = folder
    queries = __spark_entry__.queries()
    got = {r["listing_id"]: (r["low"], r["high"]) for r in queries["bootstrap_interval"](spark, path).collect()}
    documents = {r["listing_id"]: json.loads(r["document"]) for r in queries["listing_reports"](spark, path).collect()}
    assert sorted(got) == [0, 1, 7, 50]
    for k, interval in got.items():
        assert interval == pytest.approx(_interval(rows, k), abs=1e-8)
        # reports have the interval of the probability
        assert documents[k].get("probability") is None or documents[k]["low"] <= documents[k]["high"]
    assert any(got[k] != pytest.approx(_interval(rows, k, 20), abs=1e-8) for k in got)
