"""Structured Streaming: ingestion with dedupe, retention, recomputation, rate limits and watch state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reviewlens.operators import history, store

RETENTION_DAYS = 90
MAX_BATCH, MAX_SIGNATURE = 500, 128
CLAIM = ["reviewer_hash", "product_hash", "star_rating", "week_bucket", "verified"]
EDGE_SCHEMA = "batch_id string, reviewer_hash string, product_hash string, star_rating int, week_bucket int, verified boolean, minhash_signature array<string>, received_at timestamp"


def valid_edge() -> Column:
    """An edge as the service takes it: hex hashes, bounded rating, week and signature."""
    hexes = F.col("reviewer_hash").rlike("^[0-9a-f]{64}$") & F.col("product_hash").rlike("^[0-9a-f]{64}$")
    bounds = F.col("star_rating").between(1, 5) & F.col("week_bucket").between(0, 5000)
    signature = F.coalesce("minhash_signature", F.array().cast("array<string>"))
    return F.coalesce(hexes & bounds & (F.size(signature) <= MAX_SIGNATURE) & F.forall(signature, lambda s: s.rlike("^[0-9]{1,20}$")), F.lit(False))


def accepted(edges: DataFrame) -> DataFrame:
    """Edges of whole batches that are valid: one bad edge, or too many, rejects its batch."""
    per = edges.withColumn("_ok", valid_edge()).groupBy("batch_id").agg(F.min("_ok").alias("_all"), F.count("*").alias("_n"))
    good = per.where((F.col("_all")) & (F.col("_n") <= MAX_BATCH)).select("batch_id")
    return edges.join(good, "batch_id", "left_semi")


def deduplicated(stream: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Each claim once while it is retained; a null verification equals another.  State is bounded by the watermark."""
    keyed = stream.withColumn("_v", F.coalesce(F.col("verified").cast("string"), F.lit("-")))
    out = keyed.withWatermark("received_at", f"{days} days").dropDuplicatesWithinWatermark([c for c in CLAIM if c != "verified"] + ["_v"])
    return out.drop("_v")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, capacity: int | None = None, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Read JSON batches from a folder, validate whole batches and append claims that aren't held yet to a table by day of arrival.

    A micro-batch writes to a part of the table that is its own (``source=<number>``),
    overwriting it, so a replayed batch adds nothing; claims of other parts are left
    out, so no claim is held twice.  With ``capacity`` a batch that would exceed it is refused whole.
    """
    stream = spark.readStream.schema(EDGE_SCHEMA).json(folder)

    def append(batch: DataFrame, number: int) -> None:
        clean = accepted(batch).drop("minhash_signature", "batch_id").withColumn("day", F.to_date("received_at"))
        others = held(batch.sparkSession, target).where(F.col("source") != number)
        fresh = store.unclaimed(clean, others).withColumn("source", F.lit(number)).persist()
        try:
            if capacity is not None and not within_capacity(others.count(), fresh.count(), capacity):
                return
            write = fresh.write.mode("overwrite").partitionBy("day", "source").option("partitionOverwriteMode", "dynamic")
            write.parquet(target)
        finally:
            fresh.unpersist()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


HELD = "reviewer_hash string, product_hash string, star_rating int, week_bucket int, verified boolean, received_at timestamp, day date, source long"


def held(spark: SparkSession, target: str) -> DataFrame:
    """The edges of a table that ``ingest`` fills; none before its first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(HELD).parquet(target) if there else spark.createDataFrame([], HELD)


def retained(edges: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Edges that arrived within the retention (the limit itself stays); of a table by ``day`` older days aren't read."""
    return store.list_since(edges, now - F.expr(f"INTERVAL {days} DAYS"))


def prune(spark: SparkSession, target: str, now: Column, days: int = RETENTION_DAYS) -> int:
    """Delete the days of a table that are past the retention; returns how many."""
    return store.prune_older(spark, target, now - F.expr(f"INTERVAL {days} DAYS"))


def within_capacity(held: int, incoming: int, most: int = 2_000_000) -> bool:
    """Whether so many more edges may be held."""
    return held + incoming <= most


def daily_windows(stream: DataFrame, time: str = "ts", delay: str = "2 days") -> DataFrame:
    """day, n of an event stream, with late events up to the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def _replay_window(times: list[float], limit: int, span: float, hits: list[float]) -> tuple[list[bool], list[float]]:
    out = []
    for t in times:
        hits = [h for h in hits if h > t - span]
        ok = len(hits) < limit
        if ok:
            hits.append(t)
        out.append(ok)
    return out, hits


def limit_rate(requests: DataFrame, limit: int = 30, span_s: float = 60.0, key: str = "origin") -> DataFrame:
    """key, at (seconds), allowed: a sliding window per key in which denied requests don't count.

    Works on a stream (state: at most ``limit`` times a key) and on a table.
    """
    kind = requests.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, at double, allowed boolean"
    if not requests.isStreaming:

        def whole(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("at", kind="stable")
            return part[[key, "at"]].assign(allowed=_replay_window(part["at"].tolist(), limit, span_s, [])[0])

        return requests.select(key, "at").groupBy(key).applyInPandas(whole, schema)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # nobody asked for a whole span: no hit of it counts any more
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        allowed, hits = _replay_window(rows["at"].tolist(), limit, span_s, hits)
        state.update((hits,))
        state.setTimeoutDuration(max(1, int(span_s * 1000)))
        yield rows[[key, "at"]].assign(allowed=allowed)

    return requests.select(key, "at").groupBy(key).applyInPandasWithState(step, schema, "hits array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _replay_tokens(times: list[float], rate: float, burst: float, tokens: float, filled: float | None) -> tuple[list[bool], float, float | None]:
    out = []
    for t in times:
        tokens = burst if filled is None else min(burst, tokens + (t - filled) * rate)
        filled = t
        ok = tokens >= 1
        tokens -= ok
        out.append(bool(ok))
    return out, tokens, filled


def token_bucket(requests: DataFrame, rate: float = 20.0, burst: float = 120.0, key: str = "service") -> DataFrame:
    """key, at, allowed: a bucket per key that fills with time up to ``burst``.

    Works on a table, and on a stream (state: tokens and when they were counted; a
    bucket that has had the time to fill up is forgotten).
    """
    kind = requests.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, at double, allowed boolean"

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at", kind="stable")
        return part[[key, "at"]].assign(allowed=_replay_tokens(part["at"].tolist(), rate, burst, burst, None)[0])

    if not requests.isStreaming:
        return requests.select(key, "at").groupBy(key).applyInPandas(replay, schema)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, filled = state.get if state.exists else (burst, None)
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        allowed, tokens, filled = _replay_tokens(rows["at"].tolist(), rate, burst, tokens, filled)
        state.update((float(tokens), float(filled)))
        state.setTimeoutDuration(max(1, int(burst / rate * 1000)))
        yield rows[[key, "at"]].assign(allowed=allowed)

    return requests.select(key, "at").groupBy(key).applyInPandasWithState(step, schema, "tokens double, filled double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def in_flight(requests: DataFrame, most: int = 32, key: str = "service") -> DataFrame:
    """``requests`` (at, took) with busy (others of the key still running when one starts) and admitted (busy < most), by counting starts and ends.

    All requests count as running, as they do for who measures the load from outside.
    """
    starts = requests.select(key, F.col("at").alias("t"), F.lit(1).alias("d"))
    ends = requests.select(key, (F.col("at") + F.col("took")).alias("t"), F.lit(-1).alias("d"))
    per = starts.union(ends).groupBy(key, "t").agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("down"))
    before = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    level = per.withColumn("busy", F.coalesce(F.sum(F.col("up") - F.col("down")).over(before), F.lit(0)) - F.col("down"))
    out = requests.join(level.select(key, F.col("t").alias("at"), "busy"), [key, "at"])
    return out.withColumn("admitted", F.col("busy") < most)


def watch_stream(readings: DataFrame, schema: str, key: str = "product_key") -> DataFrame:
    """key, checks, changes (array of kinds) of each micro-batch of a stream of readings (at, band, rating, reviews, burst, drift).

    The first reading of a key is its baseline and stays; the latest is compared with it.
    """
    fields = ["band", "rating", "reviews", "burst", "drift"]

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        first, checks = (json.loads(state.get[0]), state.get[1]) if state.exists else (None, 0)
        as_row = lambda r: {f: None if pd.isna(r[f]) else (r[f] if f == "band" else float(r[f])) for f in fields}
        first = first or as_row(rows.iloc[0])
        latest, checks = as_row(rows.iloc[-1]), checks + len(rows)
        state.update((json.dumps(first), checks))
        yield pd.DataFrame({key: [group[0]], "checks": [checks], "changes": [history.changed_kinds(first, latest)]})

    return readings.groupBy(key).applyInPandasWithState(step, schema, "first string, checks long", "update", GroupStateTimeout.NoTimeout)


def recompute(spark: SparkSession, edges_path: str, flags_path: str, now: Column) -> None:
    """Flags of the retained edges are added to the table of flags; none is ever removed."""
    from reviewlens.operators import graph

    new = graph.flagged_reviewers(retained(spark.read.parquet(edges_path), now))
    try:
        old = spark.read.schema("reviewer_hash string").parquet(flags_path)
        new = new.join(old, "reviewer_hash", "left_anti")
    except Exception as e:  # the table isn't there before the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.distinct().write.mode("append").parquet(flags_path)


def progress_samples(query: StreamingQuery) -> list[tuple[str, str, str, dict, float]]:
    """Counters and gauges of a running query, as samples for ``notices.metrics_text``: batches, rows, rows a second, rows of state."""
    progress = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    label = {"query": query.name or str(query.id)}
    last = progress[-1] if progress else {}
    rows = sum(p.get("numInputRows", 0) for p in progress)
    state = sum(s.get("numRowsTotal", 0) for s in last.get("stateOperators", []))
    return [
        ("stream_batches", "counter", "Micro-batches.", label, float(len(progress))),
        ("stream_rows", "counter", "Rows read.", label, float(rows)),
        ("stream_rows_per_second", "gauge", "Rows a second in the last batch.", label, float(last.get("processedRowsPerSecond") or 0.0)),
        ("stream_state_rows", "gauge", "Rows of state.", label, float(state)),
    ]


def health(queries: dict[str, StreamingQuery | None], most_idle_s: float, now: float) -> dict[str, str]:
    """State of each named query: ok, stale (its last batch is too long ago), failed (it ended with an error) or missing."""
    out = {}
    for name, query in queries.items():
        if query is None:
            out[name] = "missing"
        elif query.exception() is not None:
            out[name] = "failed"
        else:
            last = query.lastProgress
            stamp = pd.Timestamp((last if isinstance(last, dict) else json.loads(last.json))["timestamp"]).timestamp() if last else None
            out[name] = "ok" if stamp is not None and now - stamp <= most_idle_s else "stale"
    return out
