"""The reviewer graph: sanitised edges, projection, backbone, communities and flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import and_, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewlens.functions import stats
from reviewlens.operators import copairs
from reviewlens.session import stored, unstored

# Degree caps and significance levels.
MAX_PRODUCTS, MAX_REVIEWERS = 500, 5000
LEVEL = 0.05
FLAG_AT = 0.6
#: Most pairs whose components are found in one task.
FEW = 1 << 20
#: Edges that one task sorts when degrees are capped, about.
BLOCKED = 250_000
CLAIM = ["star_rating", "week_bucket", "verified"]


def sanitise(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One edge for each reviewer and product that claim one thing, the earliest; and per pair what was dropped.

    Identities with two different claims are dropped whole (conflicts); repeats of
    a claim count as duplicates.  A null verification is a claim like any other.
    """
    least = lambda c: [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}")]
    together = edges.select("reviewer_hash", "product_hash", *CLAIM, "received_at").repartition("reviewer_hash", "product_hash")
    per = together.groupBy("reviewer_hash", "product_hash").agg(F.count("*").alias("n"), *[x for c in CLAIM for x in least(c)], F.count("received_at").alias("n_received"), F.min("received_at").alias("first_received"))
    # nulls count as values: all are null, or none is and all are equal
    single = reduce(and_, [(F.col(f"n_{c}") == 0) | (F.col(f"n_{c}") == F.col("n")) & (F.col(f"low_{c}") == F.col(f"high_{c}")) for c in CLAIM])
    # without a time comes before all times
    first = F.when(F.col("n_received") == F.col("n"), F.col("first_received"))
    kept = per.where(single).select("reviewer_hash", "product_hash", *[F.col(f"low_{c}").alias(c) for c in CLAIM], first.alias("received_at"))
    dropped = per.select("reviewer_hash", "product_hash", F.when(single, 0).otherwise(F.col("n")).alias("conflicts"), F.when(single, F.col("n") - 1).otherwise(0).alias("duplicates"))
    return kept, dropped


def _as_is(key: Column) -> Column:
    return key


def cap_degrees(edges: DataFrame, max_products: int = MAX_PRODUCTS, max_reviewers: int = MAX_REVIEWERS, name: Callable[[Column], Column] = _as_is, product_name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """Edges accepted in the order (received_at, reviewer, product), nulls last, while both ends are under their caps.

    A dropped edge doesn't count; a null end is a node like any other.  Where no node is
    over its cap nothing is dropped and nothing is gathered; else edges of nodes over a cap
    (all, if these are a half) are sorted in parallel, and only their ends pass through
    one task in blocks, which keeps a count for each node.
    Edges may have shorter keys than hashes: the order is that of the names, which
    ``name`` and ``product_name`` make of keys.
    """
    ends = (("reviewer_hash", max_products), ("product_hash", max_reviewers))
    degrees = [edges.groupBy(c).count() for c, _ in ends]
    told = [d.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("count") > most, F.col("count"))), F.lit(0)), F.min(c), F.max(c)).first() for d, (c, most) in zip(degrees, ends, strict=True)]
    if not any(x[2] for x in told):
        return edges
    n, tight, free = told[0][1], edges, None
    if 2 * sum(x[2] for x in told) < n:
        # an edge between two nodes that are under their caps is always accepted and changes no other edge
        marked = edges
        for d, (c, most) in zip(degrees, ends, strict=True):
            over = d.where(F.col("count") > most).select(F.col(c).alias("_key"), F.lit(True).alias(f"_{c}"))
            marked = marked.join(over, F.col(c).eqNullSafe(F.col("_key")), "left").drop("_key")
        marked = stored(marked, "marked")
        is_over = F.coalesce(*[F.col(f"_{c}") for c, _ in ends]).isNotNull()
        tight, free = marked.where(is_over).select(*edges.columns), marked.where(~is_over).select(*edges.columns)
    blocks = stored(_in_order(tight, n, name, product_name), "ordered")
    # numbers without large gaps count in arrays as they are
    dense = [edges.schema[c].dataType.typeName() in ("integer", "long") and x[3] is not None and x[3] >= 0 and x[4] < 8 * x[0] + 1000 and x[4] + 2 for (c, _), x in zip(ends, told, strict=True)]
    scan = blocks.select("part", "seq", "ends").repartition(1).sortWithinPartitions("part", "seq")
    masks = stored(scan.mapInArrow(_accepted(max_products, max_reviewers, dense), "part int, seq int, mask binary"), "accepted")
    kept = blocks.join(masks, ["part", "seq"]).select("ends", "rest", "mask").mapInArrow(_unblocked(edges.columns), edges.schema)
    return kept if free is None else free.unionByName(kept)


def _in_order(edges: DataFrame, n: int, name: Callable[[Column], Column], product_name: Callable[[Column], Column]) -> DataFrame:
    """Blocks (part, seq, ends, rest) of edges, which are in the order of part and seq and in each block: the two ends, and the other columns."""
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCKED))
    most = edges.groupBy("received_at").count().agg(F.max("count")).first()[0] or 0
    # names are needed for dealing only where a time has more edges than a task should
    by = [F.col("received_at").asc_nulls_last()] + ([name(F.col("reviewer_hash")).asc_nulls_last(), product_name(F.col("product_hash")).asc_nulls_last()] if most * parts > 2 * n else [])
    dealt = edges.repartitionByRange(parts, *by).withColumns({"_r": name(F.col("reviewer_hash")), "_p": product_name(F.col("product_hash"))})
    dealt = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in ("received_at", "_r", "_p")]).drop("_r", "_p")
    names = ["reviewer_hash", "product_hash"]
    rest = [c for c in edges.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, batch in enumerate(b for b in batches if b.num_rows):
            row = [pa.array([batch.column(batch.num_columns - 1)[0].as_py()], pa.int32()), pa.array([seq], pa.int32()), *[pa.array([_as_stream(batch.select(c))], pa.binary()) for c in (names, rest)]]
            yield pa.RecordBatch.from_arrays(row, names=["part", "seq", "ends", "rest"])

    return dealt.select(*names, *rest, F.spark_partition_id().alias("_part")).mapInArrow(run, "part int, seq int, ends binary, rest binary")


def _as_stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _accepted(max_products: int, max_reviewers: int, dense: list[int | bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of edges in their order to bits (part, seq, mask) that tell which are accepted.

    dense: for each end the length of an array that has a place for every number and one for null; False: nodes are told by a dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caps = (max_products, max_reviewers)
        known: tuple[dict, dict] = ({}, {})
        counts = [np.zeros(size or 1024, np.int32) for size in dense]
        for batch in batches:
            for part, seq, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                block = pa.ipc.open_stream(data).read_all()
                nodes = []
                for x in (0, 1):
                    keys = block.column(x)
                    if dense[x]:
                        nodes.append(keys.fill_null(dense[x] - 1).to_numpy())
                    else:
                        nodes.append(np.fromiter((known[x].setdefault(k, len(known[x])) for k in keys.to_pylist()), np.int64, len(keys)))
                        if len(known[x]) > len(counts[x]):
                            counts[x] = np.concatenate((counts[x], np.zeros(2 * len(known[x]) - len(counts[x]), np.int32)))
                keep = np.logical_and.reduce([counts[x][nodes[x]] < caps[x] for x in (0, 1)])
                # where all of a node's edges in the block fit, those edges ask the other end only
                live = np.flatnonzero(keep)
                tight = np.zeros(len(live), np.bool_)
                for x in (0, 1):
                    ids, inverse, times = np.unique(nodes[x][live], return_inverse=True, return_counts=True)
                    tight |= (counts[x][ids] + times > caps[x])[inverse]
                unsure, sure = live[tight], live[~tight]
                for x in (0, 1):
                    np.add.at(counts[x], nodes[x][sure], 1)
                held = [dict(zip((ids := np.unique(nodes[x][unsure])).tolist(), counts[x][ids].tolist(), strict=True)) for x in (0, 1)]
                of_r, of_p = held
                for i, r, p in zip(unsure.tolist(), nodes[0][unsure].tolist(), nodes[1][unsure].tolist(), strict=True):
                    if of_r[r] < max_products and of_p[p] < max_reviewers:
                        of_r[r] += 1
                        of_p[p] += 1
                    else:
                        keep[i] = False
                for x in (0, 1):
                    counts[x][np.fromiter(held[x].keys(), np.int64, len(held[x]))] = np.fromiter(held[x].values(), np.int32, len(held[x]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([np.packbits(keep).tobytes()], pa.binary())], names=["part", "seq", "mask"])

    return run


def _unblocked(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The accepted rows of blocks (ends, rest, mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends, rest, mask = (batch.column(x)[i].as_py() for x in range(3))
                left, right = (pa.ipc.open_stream(x).read_all() for x in (ends, rest))
                keep = pa.array(np.unpackbits(np.frombuffer(mask, np.uint8), count=left.num_rows).astype(bool))
                whole = {c: (left if c in left.column_names else right).column(c) for c in columns}
                yield from pa.table(whole).filter(keep).combine_chunks().to_batches()

    return run


def project(edges: DataFrame, level: float = LEVEL, name: Callable[[Column], Column] = _as_is, unique: bool = False, digits: int | None = None) -> DataFrame:
    """a, b (a < b), overlap, p_value, weight of reviewers whose common products are significantly many.

    Products move as lists of reviewers, pairs are unrolled and counted where a
    reviewer's whole row is (``copairs``).  ``name`` makes what is returned from keys,
    once for each reviewer, so that edges can have shorter keys than hashes.  unique:
    edges are a stored table without repeats; the result doesn't read it.  digits: what
    weights are rounded to, which is done once for all pairs of equal figures; p_value
    is left out then.
    """
    return copairs.pairs(edges, level, name=name, unique=unique, digits=digits)


def backbone(projected: DataFrame, level: float = LEVEL) -> DataFrame:
    """a, b, weight of edges that are significant at either end (disparity filter)."""
    ends = projected.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    nodes = ends.groupBy("node").agg(F.sum("weight").alias("s"), F.count("*").alias("k"))
    j = projected.join(nodes.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("k").alias("ka")), "a").join(nodes.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("k").alias("kb")), "b")
    low = F.least(stats.disparity_alpha(F.col("weight") / F.col("sa"), F.col("ka")), stats.disparity_alpha(F.col("weight") / F.col("sb"), F.col("kb")))
    return j.where(low < level).select("a", "b", "weight")


def numbered_backbone(edges: DataFrame, level: float = LEVEL, name: Callable[[Column], Column] = _as_is, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """``projected_backbone`` with reviewers' numbers as a and b, and the names (key, name, id): numbers are in the order of names and a tenth as long.

    unique: edges are a stored table without repeats.
    """
    return copairs.numbered_pairs(edges, level, level, name, unique)


def named(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with names in place of the numbers in ``columns``."""
    for c in columns:
        rows = rows.join(names.select(F.col("id").alias(c), F.col("name").alias("_name")), c).withColumn(c, F.col("_name")).drop("_name")
    return rows


def projected_backbone(edges: DataFrame, level: float = LEVEL, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """``backbone(project(edges))`` in one pass: a reviewer's whole row is in one place, so only edges that an end keeps leave it."""
    return copairs.pairs(edges, level, level, name)


def _connected_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, comp of all pairs a, b."""
    rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    ends = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks])
    # smaller places are smaller nodes; a tree's root is its smallest node
    nodes, at = np.unique(ends.to_numpy(), return_inverse=True)
    a, b = at[: rows.num_rows], at[rows.num_rows :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    kind = rows.schema.field("a").type
    for x in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[x : x + 100_000], kind), pa.array(nodes[root[x : x + 100_000]], kind)], names=["node", "comp"])


def connected(pairs: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each can reach.

    Few pairs (``FEW``) are solved in one pass; of more, labels fall along edges and are
    shortened every round.
    """
    both = stored(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "both-ways")
    if both.count() <= 2 * FEW:
        kind = both.schema["a"].dataType.simpleString()
        labels = stored(both.where("a <= b").coalesce(1).mapInArrow(_connected_at_once, f"node {kind}, comp {kind}"), "labels")
        unstored(both)
        return labels
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp"), F.lit(True).alias("fell")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("low")).select(F.col("a").alias("node"), "low")
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        new = stored(least.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp").select("node", F.least("comp", "next").alias("comp"), (F.least("comp", "next") != F.col("old")).alias("fell")), "labels")
        unstored(labels)
        labels = new
        if labels.where("fell").isEmpty():
            unstored(both)
            return labels.drop("fell")


def _modularity_parts(nodes: list, edges: list[tuple[int, int, float]], total: float) -> list[int]:
    """Communities by local moving, refinement into connected parts, and aggregation, in sorted node order."""
    n = len(nodes)
    owner = list(range(n))
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    loops = [0.0] * n
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[b].get(a, 0.0) + w
    members = list(range(n))
    while True:
        size = len(graph)
        strength = [sum(g.values()) + 2 * loops[i] for i, g in enumerate(graph)]
        part = list(range(size))
        held = list(strength)
        moved_any, queue = False, list(range(size))
        queued = [True] * size
        while queue:
            batch, queue = queue, []
            for i in batch:
                queued[i] = False
                links: dict[int, float] = {}
                for j, w in graph[i].items():
                    links[part[j]] = links.get(part[j], 0.0) + w
                own = part[i]
                held[own] -= strength[i]
                best, gain = own, links.get(own, 0.0) - strength[i] * held[own] / total
                for c in sorted(links):
                    g = links[c] - strength[i] * held[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                held[best] += strength[i]
                if best != own:
                    part[i] = best
                    moved_any = True
                    for j in graph[i]:
                        if part[j] != best and not queued[j]:
                            queued[j] = True
                            queue.append(j)
        # refinement: a community is cut where it is not connected
        refined, label = [-1] * size, 0
        for i in range(size):
            if refined[i] < 0:
                stack = [i]
                refined[i] = label
                while stack:
                    x = stack.pop()
                    for y in graph[x]:
                        if refined[y] < 0 and part[y] == part[i]:
                            refined[y] = label
                            stack.append(y)
                label += 1
        members = [refined[m] for m in members]
        if not moved_any or label == size:
            break
        merged: list[dict[int, float]] = [{} for _ in range(label)]
        merged_loops = [0.0] * label
        for i, g in enumerate(graph):
            merged_loops[refined[i]] += loops[i]
            for j, w in g.items():
                a, b = refined[i], refined[j]
                if a == b:
                    merged_loops[a] += w / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        graph, loops = merged, merged_loops
    return [members[owner[i]] for i in range(n)]


def communities(edges: DataFrame) -> DataFrame:
    """node, community (its smallest node): weighted modularity, deterministic.

    Communities never span connected components, so each component is solved on its
    own, with the weight of the whole graph.
    """
    total = edges.agg(F.sum("weight")).first()[0]
    if not total:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("community")).where("false")
    comp = connected(edges)
    inside = edges.join(comp.withColumnRenamed("node", "a"), "a").select("comp", "a", "b", "weight")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list] = ([], [])
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for _, own in groupby(rows, itemgetter(0)):
            own = list(own)
            nodes = sorted({x for _, a, b, _ in own for x in (a, b)})
            at = {x: i for i, x in enumerate(nodes)}
            low: dict[int, object] = {}
            for x, c in zip(nodes, _modularity_parts(nodes, [(at[a], at[b], w) for _, a, b, w in own], 2 * total), strict=True):
                found[0].append(x)
                found[1].append(low.setdefault(c, x))
            if len(found[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in found], names=["node", "community"])
                found = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in found], names=["node", "community"])

    of, kind = edges.schema["a"].dataType.simpleString(), to_arrow_type(edges.schema["a"].dataType)
    dealt = inside.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "comp").sortWithinPartitions("comp", "a", "b")
    return dealt.mapInArrow(solve, f"node {of}, community {of}")


def by_size(parts: DataFrame) -> DataFrame:
    """community, n: the largest first, of equal ones the one with the smallest name."""
    return parts.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "community")


def score_communities(parts: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """community, n, density, homogeneity, clustering, incoherence, combined, flagged.

    parts: node, community; links: a, b; edges: reviewer_hash, star_rating,
    week_bucket and, if there, category (else one category) and community (of the reviewer).
    """
    of = lambda c: parts.select(F.col("node").alias(c), F.col("community").alias(f"{c}_c"))
    inner = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("a_c = b_c").groupBy(F.col("a_c").alias("community")).agg(F.count("*").alias("links"))
    sizes = parts.groupBy("community").agg(F.count("*").alias("n"))
    if "category" not in edges.columns:
        edges = edges.withColumn("category", F.lit(""))
    own = edges if "community" in edges.columns else edges.join(parts, F.col("reviewer_hash") == F.col("node"))
    ratings = own.groupBy("community").agg(F.count("star_rating").alias("m"), F.stddev_pop("star_rating").alias("sd"), (F.max("week_bucket") - F.min("week_bucket")).cast("double").alias("weeks"))
    per = own.groupBy("community", "category").count()
    share = F.col("count") / F.sum("count").over(Window.partitionBy("community"))
    entropy = per.withColumn("h", -share * F.log2(share)).groupBy("community").agg(F.sum("h").alias("h"), F.count("*").alias("categories"))
    j = sizes.join(inner, "community", "left").join(ratings, "community", "left").join(entropy, "community", "left")
    density = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("links", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2))
    homogeneity = F.when(F.coalesce("m", F.lit(0)) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("sd") / 2))
    clustering = F.when(F.coalesce("m", F.lit(0)) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("weeks") * 7 / 365))
    incoherence = F.when(F.coalesce("categories", F.lit(0)) < 2, 0.0).otherwise(F.col("h") / F.log2("categories"))
    out = j.select("community", "n", density.alias("density"), homogeneity.alias("homogeneity"), clustering.alias("clustering"), incoherence.alias("incoherence"))
    out = out.withColumn("combined", (F.col("density") + F.col("homogeneity") + F.col("clustering") + F.col("incoherence")) / 4)
    return out.withColumn("flagged", F.col("combined") >= FLAG_AT)


def of_members(edges: DataFrame, parts: DataFrame, names: DataFrame) -> DataFrame:
    """The edges of reviewers that ``parts`` (numbers and their communities) name, with the community; they move once."""
    ends = names.select("key", "id").join(parts.select(F.col("node").alias("id"), "community"), "id").select("key", "community")
    return edges.join(ends, F.col("reviewer_hash") == F.col("key")).drop("key")


def flagged_reviewers(edges: DataFrame, max_products: int = MAX_PRODUCTS, max_reviewers: int = MAX_REVIEWERS, name: Callable[[Column], Column] = _as_is) -> DataFrame:
    """reviewer_hash of all members of flagged communities, from raw edges.

    Edges may have shorter keys than hashes: ``name`` makes hashes of them, once for
    each reviewer.
    """
    # what the edges were joined with is off the disk before they are dealt by pairs
    raw = stored(edges, "raw")
    clean = stored(sanitise(raw)[0], "clean")
    unstored(raw)
    capped = cap_degrees(clean, max_products, max_reviewers, name)
    if capped is not clean:
        capped = stored(capped, "capped")
    links, names = numbered_backbone(capped, name=name, unique=True)
    parts = stored(communities(links), "communities")
    scores = score_communities(parts, links, of_members(capped, parts, names))
    found = stored(parts.join(scores.where("flagged").select("community"), "community").select(F.col("node").alias("reviewer_hash")), "flagged")
    unstored(*{id(x): x for x in (clean, capped, links, parts)}.values())
    return named(found, names, "reviewer_hash")


def prefix_lookup(flags: DataFrame, prefixes: DataFrame, length: int = 4) -> DataFrame:
    """prefix, hashes: for each asked prefix the flagged hashes that begin with it, sorted (none: empty)."""
    keyed = flags.select(F.substring("reviewer_hash", 1, length).alias("prefix"), "reviewer_hash").distinct()
    joined = prefixes.select("prefix").distinct().join(keyed, "prefix", "left")
    return joined.groupBy("prefix").agg(F.sort_array(F.collect_list("reviewer_hash")).alias("hashes"))


def add_flags(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Flags are only ever added."""
    return existing.select("reviewer_hash").union(new.select("reviewer_hash")).distinct()
