"""Streams against their batch forms, replayed batches, retention and load."""

import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import history
from reviewlens.sources import files
from reviewlens.streaming import ingest

T0 = dt.datetime(2026, 3, 1, 12)


def _batch(path, rows):
    edge = lambda i, b, r, v, day: {"batch_id": b, "reviewer_hash": f"{r:064x}", "product_hash": f"{1:064x}", "star_rating": 5, "week_bucket": 10, "verified": v, "minhash_signature": [], "received_at": (T0 + dt.timedelta(days=day, seconds=i)).isoformat()}
    path.write_text("".join(json.dumps(edge(i, *row)) + "\n" for i, row in enumerate(rows)))


def _held(spark, out):
    return sorted(((int(r["reviewer_hash"], 16), r["verified"], r["source"]) for r in ingest.held(spark, out).collect()), key=str)


def test_claims_across_batches(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    run = lambda cp, **more: ingest.ingest(spark, str(folder), out, str(tmp_path / cp), **more).awaitTermination(120)
    assert ingest.held(spark, out).count() == 0
    _batch(folder / "a.json", [("x", 1, None, 0), ("x", 1, None, 0), ("y", 2, True, 0), ("z", 3, True, 0), ("z", 2**300, True, 0)])
    run("cp")
    assert sorted(r[:2] for r in _held(spark, out)) == [(1, None), (2, True)]
    _batch(folder / "b.json", [("v", 1, None, 40), ("v", 1, False, 40), ("v", 4, None, 40)])
    run("cp")
    want = [(1, False, 1), (1, None, 0), (2, True, 0), (4, None, 1)]
    assert sorted(_held(spark, out), key=str) == sorted(want, key=str)
    # the second batch once more, as after a crash before its commit
    shutil.rmtree(tmp_path / "cp" / "commits")
    (tmp_path / "cp" / "commits").mkdir()
    run("cp")
    assert sorted(r[:2] for r in ((x[0], str(x[1])) for x in _held(spark, out))) == sorted((x[0], str(x[1])) for x in want)
    now = F.lit("2026-03-20 00:00:00").cast("timestamp")
    assert ingest.retained(ingest.held(spark, out), now, 10).count() == 2
    assert ingest.prune(spark, out, now, 10) == 1 and ingest.held(spark, out).count() == 2
    _batch(folder / "c.json", [("w", 9, None, 41)])
    run("cp", capacity=2)
    assert ingest.held(spark, out).count() == 2


def test_token_bucket_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", float(i) / 4) for i in range(40)] + [("t", 1.0)], "service string, at double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("service string, at double").parquet(str(tmp_path / "in"))
    ingest.token_bucket(stream, 1.0, 3.0).writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted(map(tuple, spark.table("buckets").collect()))
    assert got == sorted(map(tuple, ingest.token_bucket(rows, 1.0, 3.0).collect()))
    assert sum(ok for k, _, ok in got if k == "s") == 12


def test_in_flight(spark):
    rows = [("s", float(i), 2.5) for i in range(6)] + [("s", 2.0, 0.5), ("t", 0.0, 1.0)]
    frame = spark.createDataFrame(rows, "service string, at double, took double")
    got = {(r["service"], r["at"], r["took"]): r["busy"] for r in ingest.in_flight(frame, 3).collect()}
    for k, at, took in rows:
        assert got[k, at, took] == sum(1 for o, a, t in rows if o == k and a < at < a + t), (k, at)
    assert ingest.in_flight(frame, 2).where("NOT admitted").count() > 0


def test_watch_stream_equals_batch(spark, tmp_path):
    fields = "product_key string, id long, at timestamp, band string, rating double, reviews double, burst double, drift double"
    rows = [("p", 1, T0, "clean", 4.0, 100.0, 0.1, 0.2), ("q", 2, T0, "mixed", 3.0, 10.0, None, 0.6), ("p", 3, T0 + dt.timedelta(days=1), "mixed", 3.8, 160.0, 0.3, 0.7), ("q", 4, T0 + dt.timedelta(days=1), "mixed", 3.1, 30.0, 0.5, 0.1)]
    frame = spark.createDataFrame(rows, fields)
    folder = tmp_path / "in"
    frame.where("id < 3").coalesce(1).write.parquet(str(folder))
    frame.where("id > 2").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(folder))
    told = ingest.watch_stream(stream, "product_key string, checks long, changes array<string>")
    told.writeStream.format("memory").queryName("watched").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert all(r["changes"] == [] for r in spark.table("watched").where("checks = 1").collect())
    streamed = {r["product_key"]: r["changes"] for r in spark.table("watched").collect() if r["checks"] == 2}
    batch = {r["product_key"]: [c["kind"] for c in r["changes"]] for r in history.watch_changes(history.watch_state(frame)).collect()}
    assert streamed == batch == {"p": ["band", "rating", "reviews", "burst", "drift"], "q": []}


def test_restore_skips_broken_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    for i in range(3):
        files.snapshot(spark.range(i + 1), root, 1_000_000_000 + i)
    newest = tmp_path / "snap" / files.snapshots(spark, root)[0]
    for part in newest.glob("part-*"):
        part.write_bytes(b"PAR1 broken")
        for crc in newest.glob(".part-*.crc"):
            crc.unlink()
    assert files.restore(spark, root).count() == 2
    for name in files.snapshots(spark, root):
        shutil.rmtree(tmp_path / "snap" / name)
    with pytest.raises(FileNotFoundError):
        files.restore(spark, root)


def test_recompute_only_adds_flags(spark, tmp_path):
    # two pairs of reviewers who share twelve products and nothing else
    rows = [(f"{pair}{who}", f"{pair}p{i}", 5, 10, None, T0 + dt.timedelta(days=age)) for pair, age in (("a", 0), ("b", 50)) for who in "xy" for i in range(12)]
    rows += [(f"o{i}", f"q{(i * 7 + j * 3) % 40}", 1 + (i + j) % 5, j, True, T0 + dt.timedelta(days=50)) for i in range(30) for j in range(4)]
    edges = spark.createDataFrame(rows, "reviewer_hash string, product_hash string, star_rating int, week_bucket int, verified boolean, received_at timestamp")
    edges.withColumn("day", F.to_date("received_at")).write.partitionBy("day").parquet(str(tmp_path / "edges"))
    run = lambda day: ingest.recompute(spark, str(tmp_path / "edges"), str(tmp_path / "flags"), F.lit(str(T0 + dt.timedelta(days=day))).cast("timestamp"))
    flags = lambda: sorted(r[0] for r in spark.read.parquet(str(tmp_path / "flags")).collect())
    run(60)
    assert flags() == ["ax", "ay", "bx", "by"]
    run(120)  # the first pair is past its retention, its flags stay
    assert flags() == ["ax", "ay", "bx", "by"]
