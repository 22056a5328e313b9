"""Pairs of reviewers, held against plain counting."""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import stats
from reviewlens.operators import copairs, graph
from reviewlens.session import stored


def _rows(seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = {(f"r{r:02d}", f"p{p}") for r, p in zip(rng.integers(0, 60, 700).tolist(), rng.integers(0, 90, 700).tolist())}
    rows |= {(f"x{i}{j}", f"own{i}-{k}") for i in range(4) for j in range(3) for k in range(9)}
    return [*sorted(rows), ("r01", None), (None, "p1"), ("r01", "p1"), ("lone", "lonely")]


def _plain(rows: list[tuple]) -> dict:
    rows = set(rows)
    products = {p for _, p in rows if p is not None}
    degree = Counter(r for r, _ in rows)
    overlap = Counter(pair for q in products for pair in combinations(sorted(r for r, p in rows if p == q and r is not None), 2))
    return {(a, b): (n, stats.overlap_pvalue_of(len(products), degree[a], degree[b], n)) for (a, b), n in overlap.items()}


def test_pairs(spark):
    rows = _rows()
    want = {k: (n, pytest.approx(p)) for k, (n, p) in _plain(rows).items() if p < 0.05}
    edges = spark.createDataFrame(rows, "reviewer_hash string, product_hash string")
    assert {(r["a"], r["b"]): (r["overlap"], r["p_value"]) for r in graph.project(edges).collect()} == want
    # the whole backbone leaves in one pass, also under other names
    bone = {(r["a"], r["b"]): pytest.approx(r["weight"]) for r in graph.backbone(graph.project(edges)).collect()}
    assert {(r["a"], r["b"]): r["weight"] for r in graph.projected_backbone(edges).collect()} == bone and bone
    turned = lambda key: F.reverse(key)
    assert {(r["a"], r["b"]): r["weight"] for r in graph.projected_backbone(edges, name=turned).collect()} == {tuple(sorted((a[::-1], b[::-1]))): w for (a, b), w in bone.items()}
    assert graph.project(edges.where("false")).count() == graph.projected_backbone(edges.where("false")).count() == 0


def test_a_pair_moves_no_row(spark):
    """900 reviewers of two products are 404,550 pairs; none of them is in what is dealt out."""
    edges = spark.range(900).select(F.format_string("r%04d", "id").alias("reviewer_hash"), F.explode(F.array(F.lit("p"), F.lit("q"))).alias("product_hash"))
    out = graph.project(edges.union(spark.range(40).select(F.lit("lone"), F.col("id").cast("string"))))
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    assert (out.count(), out.where("overlap = 2 AND a < b").count()) == (404_550, 404_550)


def test_rows_in_pieces(monkeypatch):
    """The rows of a part come whole, however few pairs are counted at once."""
    lists = [[0, 2, 5], [1, 2, 3, 4, 5], [2, 5], [4, 6]]
    sizes = np.array([len(x) for x in lists])
    steps = np.concatenate([np.diff(x, prepend=0) for x in lists])
    block = (len(lists), len(steps), copairs._packed(np.concatenate((sizes, steps))))
    degree = np.array([1, 1, 3, 1, 2, 3, 1])
    got = []
    for most in (1, 7, 1000):
        monkeypatch.setattr(copairs, "PAIRS", most)
        got.append([(a, b, n) for part in (0, 1) for x in copairs._rows_of(part, 2, [block], degree, 50, 2.0, True) for a, b, n in zip(*(y.tolist() for y in x[:3]))])
        assert got[-1] == got[0]
    pairs = Counter(pair for x in lists for pair in combinations(x, 2))
    assert dict(((a, b), n) for a, b, n in got[0]) == {**pairs, **{(b, a): n for (a, b), n in pairs.items()}}


def test_claims_with_nulls(spark):
    rows = [("a", "p", 5, 1, None, 2), ("a", "p", 5, 1, None, 1), ("b", "p", 5, 1, None, 1), ("b", "p", 5, 1, True, 2), ("c", "p", None, 1, True, None), ("c", "p", None, 1, True, 3), ("d", "p", 5, 1, True, 1), ("d", "p", 4, 1, True, 1)]
    edges = spark.createDataFrame(rows, "reviewer_hash string, product_hash string, star_rating int, week_bucket int, verified boolean, received_at long")
    kept, dropped = graph.sanitise(edges)
    assert sorted(map(tuple, kept.collect())) == [("a", "p", 5, 1, None, 1), ("c", "p", None, 1, True, None)]
    assert sorted((r["reviewer_hash"], r["conflicts"], r["duplicates"]) for r in dropped.collect()) == [("a", 0, 1), ("b", 2, 0), ("c", 0, 1), ("d", 2, 0)]


def test_components_leave_one_table(spark, tmp_path):
    """Rounds on a long path leave no tables or checkpoints behind but what the result reads, and numbers give the components of names."""
    sc = spark.sparkContext
    sc.setCheckpointDir(f"file://{tmp_path}")
    path = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["comp"] for r in graph.connected(path).collect()}
    assert got == {f"n{i:02d}": "n00" for i in range(41)} | {"x": "x", "y": "x"}
    folder = sc._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert len([x for x in os.listdir(folder) if not x.startswith(".")]) == 1

    edges = spark.createDataFrame(_rows(), "reviewer_hash string, product_hash string")
    turned = lambda key: F.reverse(key)
    links, names = graph.numbered_backbone(edges, name=turned)
    want = {tuple(r) for r in graph.connected(graph.projected_backbone(edges, name=turned)).select("node", "comp").collect()}
    assert {tuple(r) for r in graph.named(graph.connected(links), names, "node", "comp").select("node", "comp").collect()} == want and want


def test_caps_by_names(spark):
    """Keys that are numbers are capped in the order of their names, over groups that share capped nodes or don't."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(r) + 100 * g, int(p) + 100 * g, int(r * p) % 3) for g in range(3) for r, p in zip(rng.integers(0, 30, 160), rng.integers(0, 25, 160), strict=True)})
    edges = spark.createDataFrame(rows, "reviewer_hash long, product_hash long, received_at long")
    name, product = lambda key: F.md5(key.cast("string")), lambda key: F.md5(F.concat(F.lit("p"), key.cast("string")))
    digest = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    for most_products, most_reviewers in ((4, 6), (3, 100), (100, 4)):
        want, of_r, of_p = set(), Counter(), Counter()
        for r, p, t in sorted(rows, key=lambda x: (x[2], digest(x[0]), digest(f"p{x[1]}"))):
            if of_r[r] < most_products and of_p[p] < most_reviewers:
                of_r[r] += 1
                of_p[p] += 1
                want.add((r, p, t))
        assert {tuple(x) for x in graph.cap_degrees(edges, most_products, most_reviewers, name, product).collect()} == want != set(rows)


def test_parts_in_rounds(spark, monkeypatch, tmp_path):
    """Parts dealt in rounds give the links of one round; a round sends the blocks of its own parts only and leaves no table behind."""
    sc = spark.sparkContext
    sc.setCheckpointDir(f"file://{tmp_path}")
    edges = spark.createDataFrame(_rows(), "reviewer_hash string, product_hash string")
    links, _ = copairs.numbered_pairs(edges, 0.05, 0.05, lambda key: key)
    want = {tuple(r) for r in links.collect()}
    written = []
    monkeypatch.setattr(copairs, "stored", lambda rows, name: written.append(name) or stored(rows, name))
    monkeypatch.setattr(copairs, "ROUND", 3)
    links, _ = copairs.numbered_pairs(edges, 0.05, 0.05, lambda key: key)
    assert {tuple(r) for r in links.collect()} == want and want
    assert written.count("links-of-round") > 1
    folder = sc._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert sorted(x.split("-")[0] for x in os.listdir(folder) if not x.startswith(".")) == ["links", "links", "reviewers", "reviewers"]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([[0, 1, 2, 3, 4, 5], [2, 5]], pa.list_(pa.int32()))})
    assert [x.column(0).to_pylist() for x in copairs._blocks(6)(iter([batch]))] == [[i] for i in range(6)]
    assert [x.column(0).to_pylist() for x in copairs._blocks(6, range(2, 4))(iter([batch]))] == [[2], [3]]


def test_components_at_once_and_in_rounds(spark, monkeypatch):
    """Few pairs, with nulls, repeats and pairs of one node, give the same components in one pass as in rounds."""
    rng = np.random.default_rng(7)
    rows = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 300, (150, 2)).tolist()] + [("é", "z"), ("z", "\U0001f600"), ("q", None), (None, "z"), ("self", "self")]
    pairs = spark.createDataFrame(rows, "a string, b string")
    got = {tuple(r) for r in graph.connected(pairs).collect()}
    empty = graph.connected(pairs.where("false"))
    assert (empty.count(), empty.columns) == (0, ["node", "comp"])
    monkeypatch.setattr(graph, "FEW", 0)
    assert {tuple(r) for r in graph.connected(pairs).collect()} == got and ("\U0001f600", "z") in got


def test_flags_move_raw_edges_off_first(spark, tmp_path):
    """Raw edges are gone when pairs are dealt, and only tables that the result reads stay."""
    sc = spark.sparkContext
    sc.setCheckpointDir(f"file://{tmp_path}")
    edges = spark.createDataFrame([(r, p, 5, 1, True, 1) for r, p in _rows()], "reviewer_hash string, product_hash string, star_rating int, week_bucket int, verified boolean, received_at long")
    got = {r[0] for r in graph.flagged_reviewers(edges).collect()}
    folder = sc._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not {x.split("-")[0] for x in os.listdir(folder)} & {"raw", "clean", "edges", "product", "communities"}
    # the same by names, each step on its own
    clean = graph.sanitise(edges)[0]
    links = graph.backbone(graph.project(clean))
    parts = graph.communities(links)
    bad = graph.score_communities(parts, links, clean).where("flagged").select("community")
    assert {r[0] for r in parts.join(bad, "community").select("node").collect()} == got and got


def test_names_move_to_pairs_of_groups(spark, monkeypatch):
    """Each name goes to one part for each group and not to every part; pairs within and between groups are as counted plainly."""
    rows = _rows(3)
    edges = spark.createDataFrame(rows, "reviewer_hash string, product_hash string")
    want = {k: (n, pytest.approx(p)) for k, (n, p) in _plain(rows).items() if p < 0.05}
    # about 30 parts: at least 8 groups
    lists = Counter(p for _, p in set(rows) if p is not None)
    monkeypatch.setattr(copairs, "PART_PAIRS", sum(n * n for n in lists.values()) // 30)
    moved = []
    named = copairs._named_by
    monkeypatch.setattr(copairs, "_named_by", lambda groups: moved.append(groups) or named(groups))
    assert {(r["a"], r["b"]): (r["overlap"], r["p_value"]) for r in graph.project(edges).collect()} == want
    assert 8 <= moved[0] <= 12
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(10), pa.int32()), "k": pa.array(range(10), pa.int64()), "name": pa.array(list("abcdefghij"))})
    got = {x.column(0)[0].as_py(): pa.ipc.open_stream(x.column(1)[0].as_py()).read_all()["id"].to_pylist() for x in named(4)(iter([batch]))}
    assert got == {0: [0, 4, 8], 1: [1, 5, 9], 2: [2, 6], 3: [3, 7]}


def test_caps_in_blocks(spark, monkeypatch):
    """One group of capped nodes is sorted in parts and scanned in blocks, not gathered; nulls are nodes and times like any other, last."""
    monkeypatch.setattr(graph, "BLOCKED", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    rng = np.random.default_rng(8)
    some = lambda x: None if x == 0 else int(x)
    rows = sorted({(some(r), some(p), some(t)) for r, p, t in zip(rng.integers(0, 20, 500), rng.integers(0, 30, 500), rng.integers(0, 4, 500), strict=True)}, key=str)
    rows = list({x[:2]: x for x in rows}.values())
    last = lambda x: (x is None, x or 0)
    try:
        for keys, of in (("long", lambda x: x), ("long", lambda x: x and x * 10**9), ("string", lambda x: x and f"n{x:02}")):
            edges = spark.createDataFrame([(of(r), of(p), t, 5) for r, p, t in rows], f"reviewer_hash {keys}, product_hash {keys}, received_at long, star_rating int")
            for most_products, most_reviewers in ((7, 5), (3, 100), (22, 11), (16, 100)):
                want, of_r, of_p = set(), Counter(), Counter()
                for r, p, t in sorted(rows, key=lambda x: (last(x[2]), last(x[0]), last(x[1]))):
                    if of_r[r] < most_products and of_p[p] < most_reviewers:
                        of_r[r] += 1
                        of_p[p] += 1
                        want.add((of(r), of(p), t, 5))
                capped = graph.cap_degrees(edges, most_products, most_reviewers, lambda c: F.lpad(c.cast("string"), 14, "0"), lambda c: F.lpad(c.cast("string"), 14, "0"))
                assert "InPandas" not in capped._jdf.queryExecution().toString()
                found = [tuple(x) for x in capped.collect()]
                assert set(found) == want and len(found) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_file_has_few_names(spark, monkeypatch, tmp_path):
    """A file of all pairs has names of one group in each column, so that they stay in Parquet's dictionaries; rows, names made of keys and rounded weights are as counted plainly."""
    rows = sorted(set(zip(*np.random.default_rng(5).integers(0, 400, (2, 3000)).tolist(), strict=True)))
    edges = spark.createDataFrame(rows, "reviewer_hash long, product_hash long")
    digest = lambda key: hashlib.sha256(f"c{key}".encode()).hexdigest()
    monkeypatch.setattr(copairs, "NAMES", 50 * 68, raising=False)
    monkeypatch.setattr(copairs, "WORTH", 1, raising=False)
    found = graph.project(edges, 2.0, name=lambda key: F.sha2(F.concat(F.lit("c"), key.cast("string")), 256))
    want = {k: (n, pytest.approx(p)) for k, (n, p) in _plain([(digest(r), p) for r, p in rows]).items()}
    assert {(r["a"], r["b"]): (r["overlap"], r["p_value"]) for r in found.collect()} == want
    found.write.parquet(f"file://{tmp_path}/pairs")
    files = spark.read.parquet(f"file://{tmp_path}/pairs").groupBy(F.input_file_name()).agg(F.countDistinct("a"), F.countDistinct("b")).collect()
    assert len(files) == 36 and max(max(x[1:]) for x in files) <= 50
    plain = {(r["a"], r["b"]): r["weight"] for r in found.withColumn("weight", F.round("weight", 6)).collect()}
    assert {(r["a"], r["b"]): r["weight"] for r in graph.project(edges, 2.0, name=lambda key: F.sha2(F.concat(F.lit("c"), key.cast("string")), 256), digits=6).collect()} == plain
