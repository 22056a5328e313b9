"""Contribution of edges and the private lookup of flagged reviewers.

Who asks never names a reviewer: it asks for prefixes of hashes, a few real ones
among decoys, and looks for its own reviewers' hashes in what comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.operators import graph, signals

# Length of a prefix, prefixes of a request, real ones among them, requests of one asker, and the time that they may take.
PREFIX, BUCKETS, REAL, REQUESTS, BUDGET_MS = 4, 32, 8, 8, 10_000


def eligible() -> Column:
    """A review that can be contributed: it names its reviewer and a day, and has a whole rating from 1 to 5."""
    whole = (F.col("rating") == F.floor("rating")) & F.col("rating").between(1, 5)
    return F.coalesce(F.col("reviewer_id").isNotNull() & signals.on_timeline() & whole, F.lit(False))


def contribution_edges(reviews: DataFrame, salt: str, product: str = "listing_id", signature: bool = False) -> DataFrame:
    """reviewer_hash, product_hash, star_rating, week_bucket, verified and, if wanted, minhash_signature (decimal strings; empty without text)."""
    rows = reviews.where(eligible())
    out = [
        T.salted(F.col("reviewer_id"), salt).alias("reviewer_hash"),
        T.salted(F.col(product).cast("string"), salt).alias("product_hash"),
        F.col("rating").cast("int").alias("star_rating"),
        F.floor(F.unix_date("review_date") / 7).cast("int").alias("week_bucket"),
        "verified",
    ]
    if signature:
        numbers = F.transform(T.signature(T.fold_space(F.col("text"))), lambda x: x.cast("string"))
        out.append(F.when(F.length("text") > 0, numbers).otherwise(F.array().cast("array<string>")).alias("minhash_signature"))
    return rows.select(*out)


def valid_request(prefixes: Column) -> Column:
    """Exactly 32 distinct prefixes of four lower-case hex digits."""
    shaped = F.forall(prefixes, lambda p: F.coalesce(p.rlike("^[0-9a-f]{4}$"), F.lit(False)))
    return F.coalesce((F.size(prefixes) == BUCKETS) & (F.size(F.array_distinct(prefixes)) == BUCKETS) & shaped, F.lit(False))


def prefixes_of(ids: DataFrame, salt: str, asker: str, reviewer: str = "reviewer_id") -> DataFrame:
    """asker, prefix: the distinct prefixes of each asker's reviewers."""
    return ids.where(F.col(reviewer).isNotNull()).select(asker, F.substring(T.salted(F.col(reviewer), salt), 1, PREFIX).alias("prefix")).distinct()


def _draw(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def requests(ids: DataFrame, salt: str, asker: str = "listing_id", reviewer: str = "reviewer_id", seed: int = 0) -> DataFrame:
    """asker, request, prefixes: at most eight requests of 32 distinct prefixes in drawn order, at most eight of them real.

    An asker without reviewers asks for decoys alone, so that asking says nothing.
    Prefixes beyond 64 aren't asked for (the drawn order says which).  Draws are
    hashes of the seed, so a retried task asks the same.
    """
    real = prefixes_of(ids, salt, asker, reviewer)
    place = F.row_number().over(Window.partitionBy(asker).orderBy(_draw(seed, F.col(asker), F.col("prefix")), "prefix")) - 1
    real = real.withColumn("_n", place).where(F.col("_n") < REAL * REQUESTS)
    real = real.groupBy(asker, F.floor(F.col("_n") / REAL).cast("int").alias("request")).agg(F.collect_list("prefix").alias("real"))
    everyone = ids.select(asker).distinct().join(real, asker, "left")
    rows = everyone.select(asker, F.coalesce("request", F.lit(0)).alias("request"), F.coalesce("real", F.array().cast("array<string>")).alias("real"))
    # far more decoys than are needed, so that colliding ones don't matter
    decoys = F.transform(F.sequence(F.lit(0), F.lit(4 * BUCKETS)), lambda i: F.substring(_draw(seed, F.col(asker), F.col("request"), F.lit("decoy"), i), 1, PREFIX))
    asked = F.slice(F.array_distinct(F.concat("real", decoys)), 1, BUCKETS)
    drawn = F.array_sort(F.transform(asked, lambda p: F.struct(_draw(seed + 1, F.col(asker), F.col("request"), p).alias("k"), p.alias("p"))))
    return rows.select(asker, "request", F.transform(drawn, lambda x: x["p"]).alias("prefixes"))


def answer(asked: DataFrame, flags: DataFrame, asker: str = "listing_id") -> DataFrame:
    """asker, request, prefix, hashes: for every prefix of the valid requests the flagged hashes that begin with it (none: empty)."""
    rows = asked.where(valid_request(F.col("prefixes"))).select(asker, "request", F.explode("prefixes").alias("prefix"))
    known = graph.prefix_lookup(flags, rows)
    return rows.join(known, "prefix").select(asker, "request", "prefix", "hashes")


def match(ids: DataFrame, answers: DataFrame, salt: str, asker: str = "listing_id", reviewer: str = "reviewer_id") -> DataFrame:
    """asker, reviewer: the asker's reviewers whose hash came back."""
    got = answers.select(asker, F.explode("hashes").alias("_h")).distinct()
    own = ids.where(F.col(reviewer).isNotNull()).select(asker, reviewer).distinct().withColumn("_h", T.salted(F.col(reviewer), salt))
    return own.join(got, [asker, "_h"], "left_semi").select(asker, reviewer)


def flagged_of(ids: DataFrame, flags: DataFrame, salt: str, asker: str = "listing_id", reviewer: str = "reviewer_id", seed: int = 0, answered: Column | None = None) -> DataFrame:
    """asker, reviewer: the whole lookup.  answered: which requests came back in time (by default all); what is partial still counts."""
    asked = requests(ids, salt, asker, reviewer, seed)
    return match(ids, answer(asked if answered is None else asked.where(answered), flags, asker), salt, asker, reviewer)


def in_budget(request: Column, pace_ms: Column, budget_ms: int = BUDGET_MS) -> Column:
    """Whether a request is still sent when each takes so many milliseconds."""
    return request * pace_ms < budget_ms
