"""All operators and stages on a table whose extra columns are named like what they return, with nulls, repeated rows and repeated keys."""

import math
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from reviewlens.llm import ann, bpe, line_dedup, near_dedup, packing, quality, sharding, suffix_dedup, toxicity, wavelet
from tests.llm.test_operators import frame, prose

#: Every column that an operator returns, and names that they use on the way.
NAMES = (
    "n_lines n_removed n_tokens ids_sha256 decoded_sha256 exact start ids_crc32 file ids p_toxic is_toxic toxic n_shingles component_id kept sig sketch node unit tree comp mask "
    "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_boiler_words lines line piece length sequence_id offset part local rank "
    "n_bytes n_spans kept_sha256 spans a b k n s e pos gram size text_crc32 law shard slot grown_shard t w c u v id key body"
).split()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(40)
    body = "\n".join(prose(rng, 14) for _ in range(9))
    other = "\n".join(prose(rng, 14) for _ in range(5))
    rows = [(1, body), (1, body), (2, body), (2, other), (2, None), (None, other), (None, None), (7, ""), (8, body.replace("\n", " ")), (9, other + " end"), (10, prose(rng, 40))]
    docs = frame(spark, [t for _, t in rows], [k for k, _ in rows])
    for name in NAMES:
        docs = docs.selectExpr("*", f"'{name}' AS `{name}`")
    return docs


def _keys(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_operators(spark, odd):
    keys = sorted((r["doc_id"] for r in odd.collect()), key=str)
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd, marks, {"toxic": "toxic"})
    results = {
        "op1": line_dedup.dedup_lines(odd),
        "op2": bpe.encode_decode(odd),
        "op3": wavelet.token_files(odd),
        "op4": toxicity.score(odd, chain),
        "op6": near_dedup.near_duplicates(odd),
        "op7": quality.quality(odd),
        "op8": packing.pack(odd),
        "op9": suffix_dedup.remove_repeats(odd),
        "op10": sharding.placement(odd),
    }
    for name, df in results.items():
        assert len({c.lower() for c in df.columns}) == len(df.columns), name
        assert _keys(df) == keys, name
    # what an operator says of its rows wins over a column of the same name, all others pass
    for name in ("op1", "op9"):
        rows = results[name].collect()
        assert all(isinstance(r["n_removed"], int) for r in rows) and {r["grown_shard"] for r in rows} == {"grown_shard"}


def test_stages(spark, odd):
    sizes = []
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == odd.columns
        rows = out.collect()
        sizes.append(len(rows))
        assert all(r[name] == name for r in rows for name in NAMES)
        docs = spark.createDataFrame(rows, odd.schema)
    assert sizes[0] == 8 and sizes[2] == len({r["text"] for r in docs.collect()})
    packed = corpus_pipeline.packing(spark, docs, "")
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [9.0, 9.0]), (1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0]), (3, [3.0, 2.0, 3.0]), (None, [1.0, 1.0]), (4, None), (5, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "v", "dim", "score", "rank", "query_id", "code", "norm", "own", "low", "high"):
        table = table.selectExpr("*", f"'{name}' AS `{name}`")
    got = [tuple(r) for r in ann.search(table, table.where("vec_id IN (1, 3)")).collect()]
    assert got == [(1, 1, 2, 1.0)]  # 1 counts with its shortest, smallest vector


def test_bounds_hold():
    rng = np.random.default_rng(41)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((40, 64))
    x[7] = x.mean(axis=0)
    mean = x.mean(axis=0)
    codes = ann.Codes.of(x, mean, ann.rotation(64))
    low, high = codes.bounds(q, mean, ann.rotation(64))
    true = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    assert np.mean((low <= true) & (true <= high)) > 0.995
    assert np.mean(high - low) < 0.5 * np.mean(true)
    ids, asked = np.arange(3000), np.arange(5000, 5040)
    nearest = np.argsort(true, axis=1, kind="stable")[:, :10]
    places, found, estimate = ann.chosen(asked, q, ids, codes, mean, ann.rotation(64), 30)
    assert len(places) == 40 * 30 and estimate.max() < np.median(true)
    limits = np.array([np.sort(true[i, found[places == i]])[9] for i in range(40)])
    places, found, _ = ann.chosen(asked, q, ids, codes, mean, ann.rotation(64), 30, limits)
    hits = sum(len(set(found[places == i].tolist()) & set(nearest[i].tolist())) for i in range(40))
    assert hits >= 398 and len(places) < 0.1 * true.size


def _spark_xxhash64(parts):
    """Spark's xxhash64 of strings and longs: each value's hash is the seed of the next."""
    seed = 42
    for x in parts:
        data = x.encode() if isinstance(x, str) else int(x).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def _descend(node, key):
    while node.children:
        draws = []
        for child in node.children:
            u = ((_spark_xxhash64([child.name, key]) >> 12) + 0.5) / (1 << 52)
            draws.append((-math.log(u) / child.weight, child))
        node = min(draws, key=lambda d: d[0])[1] if len(draws) > 1 else draws[0][1]
    return node.shard


def test_descent(spark):
    keys = [*range(300), 2**62, -5]
    rows = {r["doc_id"]: r for r in sharding.placement(frame(spark, ["x"] * len(keys), keys)).collect()}
    tree = sharding.balanced(16)
    more = sharding.grown(tree)
    for k in keys:
        assert (rows[k]["shard"], rows[k]["grown_shard"]) == (_descend(tree, k), _descend(more, k))


def test_chain_inputs_are_out_of_fold():
    """The second model of a chain, fitted again by a plain loop over the folds of the first."""
    rng = np.random.default_rng(42)
    n, folds = 60, toxicity.FOLDS
    sets = [np.unique(rng.integers(0, 12, 5)).astype(np.uint64) for _ in range(n)]
    value, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    labels = np.column_stack([[int(3 in s) ^ int(rng.random() < 0.1) for s in sets], [int(3 in s or 4 in s) for s in sets]])
    chain = toxicity.fit_chain(value, offsets, labels, ["a", "b"], folds, 1)
    vocabulary = np.unique(value)
    rows, cols = np.repeat(np.arange(n), np.diff(offsets)), np.searchsorted(vocabulary, value)
    first = np.zeros(n)
    for f in range(folds):
        train = np.array([i % folds != f for i in range(n)])
        model = toxicity.fit(rows, cols, n, len(vocabulary), np.zeros((n, 0)), labels[:, 0].astype(float), train)
        for i in range(n):
            if i % folds == f:
                first[i] = model.predict(rows, cols, n, np.zeros((n, 0)))[i]
    second = toxicity.fit(rows, cols, n, len(vocabulary), first[:, None], labels[:, 1].astype(float), np.ones(n, np.bool_))
    final = chain.models[0].predict(rows, cols, n, np.zeros((n, 0)))
    want = np.column_stack((final, second.predict(rows, cols, n, final[:, None])))
    assert np.allclose(chain.predict(value, offsets), want)
    assert not np.allclose(first, final)
