"""Reviews, listings and reviewer-product edges as views of the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """listing_id, review_id, rating, text (if wanted), review_date, date_precision, verified, reviewer_id."""
    e = table(spark, sf_dir, "events")
    if text:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        e = e.withColumn("doc_id", F.pmod("event_id", F.lit(docs.count()))).join(docs, "doc_id", "left")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("listing_id"),
        F.col("event_id").alias("review_id"),
        F.when(kind == "error", None).otherwise((1 + F.pmod(F.col("event_id") * 7 + F.col("user_id") * 3, F.lit(5))).cast("double")).alias("rating"),
        *(["text"] if text else []),
        F.to_date("ts").alias("review_date"),
        F.when(F.col("event_id") % 11 == 0, "month").when(F.col("event_id") % 13 == 0, "day").alias("date_precision"),
        F.when(kind == "purchase", True).when(kind.isin("view", "click"), False).alias("verified"),
        F.when(kind == "signup", None).otherwise(F.concat(F.lit("u"), (F.col("event_id") * 31 % 97).cast("string"))).alias("reviewer_id"),
    )


REVIEWS = """reviews_v AS (
SELECT e.user_id AS listing_id, e.event_id AS review_id,
  CASE WHEN e.event_type = 'error' THEN NULL ELSE CAST(1 + (e.event_id * 7 + e.user_id * 3) % 5 AS DOUBLE) END AS rating,
  d.text AS text, CAST(e.ts AS DATE) AS review_date,
  CASE WHEN e.event_id % 11 = 0 THEN 'month' WHEN e.event_id % 13 = 0 THEN 'day' END AS date_precision,
  CASE e.event_type WHEN 'purchase' THEN TRUE WHEN 'view' THEN FALSE WHEN 'click' THEN FALSE END AS verified,
  CASE WHEN e.event_type = 'signup' THEN NULL ELSE 'u' || CAST((e.event_id * 31) % 97 AS VARCHAR) END AS reviewer_id
FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""


def _digest(tag: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(tag), key.cast("string"), F.lit("salt")), 256)


def reviewer_name(key: Column) -> Column:
    """The hash of a customer's number."""
    return _digest("c", key)


def product_name(key: Column) -> Column:
    """The hash of a part's number from twice that number."""
    return _digest("p", F.floor(key / 2))


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False, hashed: bool = True) -> DataFrame:
    """reviewer_hash, product_hash, star_rating, week_bucket, verified, received_at; with ``repeats`` some claims come twice.

    Unless ``hashed``, numbers stand for the hashes: customers' (``reviewer_name`` makes
    hashes of them) and twice the parts'.
    """
    # what a review claims is read from its line before the join, where it is narrow
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        (1 + (F.col("l_linenumber") - 1) % 5).cast("int").alias("star_rating"),
        F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")) / 7).cast("int").alias("week_bucket"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("verified"),
    )
    e = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = e.select(
        (reviewer_name(F.col("o_custkey")) if hashed else F.col("o_custkey").cast("long")).alias("reviewer_hash"),
        (_digest("p", F.col("l_partkey")) if hashed else 2 * F.col("l_partkey").cast("long")).alias("product_hash"),
        "star_rating",
        "week_bucket",
        "verified",
        F.col("o_orderdate").alias("received_at"),
    )
    if repeats:
        # exploded, so that the join is made once
        out = out.withColumn("received_at", F.explode(F.expr("CASE WHEN week_bucket % 5 = 0 THEN array(received_at, received_at + INTERVAL 1 DAY) ELSE array(received_at) END")))
    return out


EDGES = """edges_1 AS (
SELECT sha256('c' || CAST(o.o_custkey AS VARCHAR) || 'salt') AS reviewer_hash, sha256('p' || CAST(l.l_partkey AS VARCHAR) || 'salt') AS product_hash,
  CAST(1 + (l.l_linenumber - 1) % 5 AS INTEGER) AS star_rating,
  CAST(floor(date_diff('day', DATE '1970-01-01', CAST(l.l_shipdate AS DATE)) / 7.0) AS INTEGER) AS week_bucket,
  CASE l.l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS verified, o.o_orderdate AS received_at
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
edges_v AS (SELECT * FROM edges_1 UNION ALL SELECT reviewer_hash, product_hash, star_rating, week_bucket, verified, received_at + INTERVAL 1 DAY FROM edges_1 WHERE week_bucket % 5 = 0)"""


def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edges`` in numbers with rings: customers divisible by 10 review nothing but twelve products with one partner, those that leave 5 do so in fours beside their own reviews."""
    orders = table(spark, sf_dir, "orders")
    own = edges(spark, sf_dir, hashed=False).where("reviewer_hash % 10 <> 0")
    c = F.col("o_custkey").cast("long")
    # rings of two have even numbers, rings of four odd ones; the products of rings are odd
    ring = F.when(c % 10 == 0, 2 * F.floor(c / 20)).otherwise(2 * F.floor(c / 40) + 1)
    rings = orders.where("o_custkey % 5 = 0").select(c.alias("reviewer_hash"), ring.alias("ring")).distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11))))
    extra = rings.select(
        "reviewer_hash",
        (2 * (12 * F.col("ring") + F.col("j")) + 1).alias("product_hash"),
        F.lit(5).alias("star_rating"),
        F.lit(2800).alias("week_bucket"),
        F.lit(None).cast("boolean").alias("verified"),
        F.lit("2024-01-01").cast("timestamp_ntz").cast(own.schema["received_at"].dataType).alias("received_at"),
    )
    return own.unionByName(extra)


DENSE = EDGES.replace("edges_v AS", "edges_repeated AS").replace("FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)", "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey % 10 <> 0)") + """,
rings AS (SELECT DISTINCT sha256('c' || CAST(o_custkey AS VARCHAR) || 'salt') AS reviewer_hash, CASE WHEN o_custkey % 10 = 0 THEN 'a' || CAST(o_custkey // 20 AS VARCHAR) ELSE 'b' || CAST(o_custkey // 40 AS VARCHAR) END AS ring FROM orders WHERE o_custkey % 5 = 0),
edges_v AS (SELECT * FROM edges_1 UNION ALL SELECT reviewer_hash, sha256('d' || ring || '-' || CAST(j AS VARCHAR) || 'salt'), 5, 2800, NULL, TIMESTAMP '2024-01-01' FROM rings, range(0, 12) t(j))"""
