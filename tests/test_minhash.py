"""MinHash by shifts, held against whole numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd

from reviewlens.functions import text as T
from reviewlens.operators import signals
from reviewlens.session import stored


def test_edges_of_the_modulus():
    m = T.MERSENNE
    edge = [0, 1, m - 1, m, m + 1, 2 * m, (1 << 64) - 1, 1 << 61, 1 << 32, 1 << 29]
    rng = np.random.default_rng(3)
    pairs = (np.array([1, m - 1, 1 << 32, (1 << 32) - 1, 12345], np.uint64), np.array([0, m - 1, 5, m - 2, 1], np.uint64))
    for size in (1, 10, 127, 128, 129, 700):
        hashes = [edge[i % len(edge)] for i in range(min(size, 10))] + rng.integers(0, 1 << 63, max(0, size - 10)).tolist()
        want = [min((int(x) * h + int(y)) % m for h in hashes) for x, y in zip(*pairs)]
        assert T.minhash_of(np.array(hashes, np.uint64), pairs=pairs).tolist() == want
    some = [x for x in edge if x < m]
    assert all(int(T.mulmod(np.array([x], np.uint64), np.array([y], np.uint64))[0]) == x * y % m for x in some for y in some)


def test_no_division_a_pair(monkeypatch):
    """Signatures don't call mulmod for each pair of coefficients."""
    monkeypatch.setattr(T, "mulmod", None)
    assert len(T.minhash_of(np.arange(5, dtype=np.uint64))) == 128


def test_many_sets_at_once():
    """Sets of all sizes, empty ones too, have the signatures that each has alone, also where no small value is in a set."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    sets = [rng.choice(3000, n, replace=False) for n in (5, 0, 1, 130, 700, 127, 128, 2500, 300)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    got = T.minhash_many(hashes, np.concatenate(sets), offsets)
    for x, row in zip(sets, got, strict=True):
        assert (row == T.minhash_of(hashes[x])).all()
    large = np.argsort(-T._permuted(T._reduced(hashes), *[c[:1] for c in T.coefficients()])[0].astype(np.float64))[:200]
    assert (T.minhash_many(hashes, large, np.array([0, 200]))[0] == T.minhash_of(hashes[large])).all()


def test_grams_of_few_texts_at_a_time(spark, monkeypatch):
    """A batch of many texts is taken in pieces, so that memory doesn't grow with the batch."""
    texts = ["x" * n for n in (0, 3, 9, 40, 2, 2)]
    monkeypatch.setattr(T, "CHARACTERS", 10)
    assert [list(map(len, x)) for x in T.pieces(texts)] == [[0, 3], [9], [40], [2, 2]] and list(T.pieces([])) == []
    monkeypatch.undo()
    seen, long = [], pd.Series([f"{i} " * (T.CHARACTERS // 4) for i in range(10, 15)] + [None])
    grams = T.Grams
    monkeypatch.setattr(T, "Grams", lambda x: seen.append(sum(map(len, x))) or grams(x))
    assert T.shingle_count.func(long).tolist()[:5] == [3] * 5 and max(seen) <= T.CHARACTERS and len(seen) > 1


def test_clusters_within_groups(spark):
    """Clusters are those of all linked pairs of a group, also where a band's first text isn't linked with others that are."""
    rng = np.random.default_rng(6)
    rows = []
    for grp in (1, 2):
        base = rng.integers(0, 1 << 60, 128)
        for n, changed in ((6, 20), (5, 110), (4, 60)):
            own = np.where(np.arange(128) < 124 - changed, base, rng.integers(0, 1 << 60, 128))
            for _ in range(n):
                at = rng.integers(0, 128, int(rng.integers(0, 40)))
                sig = own.copy()
                sig[at] = rng.integers(0, 1 << 60, len(at))
                rows.append((grp, len(rows), sig.tolist()))
    root = list(range(len(rows)))
    for i, (g, _, x) in enumerate(rows):
        for j in range(i):
            same = np.array(x) == np.array(rows[j][2])
            if rows[j][0] == g and same.mean() > 0.7 and same.reshape(32, 4).all(1).any():
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = dict(signals._clusters(stored(spark.createDataFrame(rows, "grp int, id long, sig array<long>"), "signed")).collect())
    assert [got.get(i, i) for i in range(len(rows))] == root and len(set(root)) < len(rows)


def test_vectors_as_bits():
    """Packed vectors are read again as they were, whatever their width, and take few bytes."""
    rng = np.random.default_rng(2)
    rows = np.stack([rng.integers(-n, n + 1, 256) for n in (0, 1, 2, 7, 8, 500, 100_000)])
    packed = T.pack_terms(rows)
    assert (T.unpack_terms(packed) == rows).all() and [len(x) // 32 for x in packed] == [1, 2, 3, 4, 5, 10, 18]
