"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm import ann, bpe, components, line_dedup, near_dedup, packing, quality, sharding, suffix_dedup, toxicity, wavelet

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, keys=None, source=None):
    keys = list(range(len(texts))) if keys is None else keys
    rows = [(k, t, "en", source[i] if source else f"src{i % 2}", len(t or "")) for i, (k, t) in enumerate(zip(keys, texts, strict=True))]
    return spark.createDataFrame(rows, COLUMNS)


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    parts = ["a", "b", "'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "12", "é", "日", "🙂", "!", " ", "　", "<|endoftext|>", "<|", "²", "don't", "\r\n", "aaaaaa", "\x1c", "\x85", "Straße "]
    return ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(400)] + ["", " ", None, "<|endoftext|>", "word " * 30_000]


def test_bpe_matches_library(spark, library, odd_texts):
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, odd_texts)).collect()}
    assert len(got) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[i]["exact"]


def test_bpe_ids_round_trip(spark):
    texts = ["Hello, world's end", "", None, "naïve 🙂"]
    ids = bpe.encode_ids(frame(spark, texts))
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(ids).collect()}
    assert [back[i] for i in range(4)] == [t or "" for t in texts]
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def test_wavelet_operations():
    ids = (np.random.default_rng(2).zipf(1.4, 5000) % 50257).astype(np.uint32)
    m = wavelet.Shard.from_bytes(wavelet.Shard(wavelet.WaveletMatrix.build(ids, 16), [3], np.array([0, 5000])).to_bytes()).matrix
    assert (m.ids() == ids).all()
    for i in (0, 1, 511, 512, 4999):
        assert m.access(i) == ids[i]
    for v in (1, 2, 9, 50256, 70000):
        assert m.occurrences(v) == np.flatnonzero(ids == v).tolist()
        assert m.count(v, 100, 700) == int((ids[100:700] == v).sum())
        low, high = np.array([0, 100, 511, 4999, 7]), np.array([5000, 700, 513, 5000, 7])
        assert m.counts(v, low, high).tolist() == [int((ids[a:b] == v).sum()) for a, b in zip(low, high, strict=True)]
    assert (m.accesses(np.arange(5000)[::-1]) == ids[::-1]).all()
    assert m.select(1, 10**6) == -1
    empty = wavelet.WaveletMatrix.build(np.zeros(0, np.uint32))
    assert empty.n == 0 and empty.count(0) == 0


def test_token_files(spark, library, odd_texts):
    keys = list(range(len(odd_texts)))[::-1]
    keys[0], keys[1] = None, None
    docs = frame(spark, odd_texts, keys)
    manifest = wavelet.write_token_files(docs, wavelet.fresh_path(spark, "t"), shard_tokens=500)
    got = wavelet.read_token_files(manifest).collect()
    want, start = [], 0
    for k, t in sorted(zip(keys, odd_texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    zeros = {r["start"]: r["n_end_ids"] for r in got}
    assert all(r["last_id"] == 0 and zeros[r["start"]] >= 1 for r in got)
    by_start = {s: t for (k, s, *_), t in zip(want, [t for _, t in sorted(zip(keys, odd_texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))], strict=True)}
    assert all(n == library.encode(by_start[s] or "", add_special_tokens=False).ids.count(0) + 1 for s, n in zeros.items())
    assert wavelet.token_files(frame(spark, [])).count() == 0


def _lines(docs):
    seen, out = set(), {}
    for k, t in docs:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(60)] + ["", "x\ny", "q\nr\ns\nt", "q\nr\ns\nt"]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    want = _lines(enumerate(texts))
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_lines"] == texts[k].count("\n") + 1 for k, r in got.items())


def test_line_dedup_odd_rows(spark):
    docs = frame(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc", None, "a\nb\nc"], [1, 1, 2, 3, None]).withColumnRenamed("lang", "starts").withColumnRenamed("source", "pos")
    rows = line_dedup.dedup_lines(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, "-" if r["text"] is None else r["text"]) for r in rows) == [(False, 0, "a\nb\nc"), (True, 1, ""), (True, 1, ""), (True, 2, ""), (True, 3, "-")]
    assert rows[0]["starts"] == "en"
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_chain_held_out(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        texts.append(prose(rng, 20).replace("w1", "the ") + (" vile" + rng.choice("abcdefgh") * 2 if toxic else "") + f" common{rng.randrange(30)}")
        labels.append((i, int(i % 2), int(toxic)))
    docs = frame(spark, [*texts, None, ""])
    marks = spark.createDataFrame([*labels[:400], (None, 1, 1), (5000, 1, 1), (401, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, marks, {"low_quality": "1 - quality", "toxic": "toxic"}, limit=300)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert len(got) == 602
    right = sum(got[i]["is_toxic"] == (i % 5 == 0) for i in range(400, 600))
    assert right >= 190
    none = toxicity.train(docs, marks.where("doc_id < 0"), {"toxic": "toxic"})
    assert not any(r["is_toxic"] for r in toxicity.score(docs, none).collect())


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:150] = x[50]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(3, [float(c) for c in x[3]], 0), (2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [None] * 16, 0), (2400, [1.0, 2.0], 0), (2500, [1.0, 3.0], 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 50 = 0"), 10, base_block=200, query_block=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 900, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        total += 10
        assert all(abs(s - d[v]) < 1e-9 for v, s in got[q])
    assert hits >= 0.95 * total
    assert got[2400] == [(2500, 1.0)] and 2000 not in got
    assert ann.search(table.where("false"), table.where("false")).count() == 0


def _sets(texts):
    out = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _components(texts, keys, percent):
    sets, label = _sets(texts), list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    low = defaultdict(lambda: float("inf"))
    for i, k in enumerate(keys):
        low[root(i)] = min(low[root(i)], k)
    return [low[root(i)] for i in range(len(texts))], sets


@pytest.mark.parametrize("leaf", [256, 6])
def test_near_dedup(spark, leaf):
    rng = random.Random(6)
    texts = ["", None, "one two", "ONE two", "   "]
    shared = prose(rng, 60)
    for _ in range(12):
        base = prose(rng, rng.choice((4, 8, 60, 200))).split()
        for _ in range(rng.choice((1, 3, 9))):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
            texts.append(" ".join(copy))
        texts.append(shared + " " + prose(rng, 40))
    texts.append(texts[-1])
    keys = random.Random(7).sample(range(1000), len(texts))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, texts, keys), leaf=leaf, depth=1).collect()}
    want, sets = _components(texts, keys, 85)
    for k, component, s in zip(keys, want, sets, strict=True):
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (len(s), component, component == k)


def test_near_dedup_hot_nodes(spark):
    """Large nodes: many near copies of one text, many texts with one passage, and small limits, so that nodes branch."""
    rng = random.Random(31)
    base, passage = prose(rng, 60).split(), prose(rng, 14)
    texts = []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
        texts.append(" ".join(copy))
    for _ in range(40):
        texts.append(passage + " " + prose(rng, 12))
        if rng.random() < 0.3:
            texts.append(texts[-1] + " more")
    keys = rng.sample(range(1000), len(texts))
    for percent in (85, 80):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup._marked(frame(spark, texts, keys), "text", "doc_id", percent, 8, 6, 3, 4).withColumnRenamed("__nd_k", "doc_id").collect()}
        want, _ = _components(texts, keys, percent)
        assert got == dict(zip(keys, want, strict=True))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(32)
    need = near_dedup.agreement(85)
    assert 80 < need < 100
    equal = []
    for _ in range(200):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (170, 15, 15))  # 170 of 200
        value = np.concatenate((common, a, common, b))
        sig, code = near_dedup.coordinates(value, np.array([0, 185, 370]))
        equal.append((np.count_nonzero(code[0] == code[1]), np.count_nonzero(sig[0] == sig[1])))
    codes, coordinates = np.array(equal).T
    assert abs(codes.mean() / near_dedup.CODES - 0.85) < 0.02 and abs(coordinates.mean() / near_dedup.COORDINATES - 0.85) < 0.03
    assert codes.min() >= need and codes.std() < 6


def test_near_dedup_odd_rows(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "z"], [None, 4, 4, 9]).withColumnRenamed("lang", "c").withColumnRenamed("source", "node")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (9, 9, True)], key=str)
    assert near_dedup.keep_first(docs).columns == docs.columns
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges for n in e}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        label[b] = a
    assert got == {n: root(n) for n in label if root(n) != n}


def _measures(t):
    words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_quality(spark):
    rng = random.Random(9)
    texts = [None, "", "\n\n", "a\n", " é x\ty \n y"]
    texts += ["\n".join(" ".join(rng.choice(("a", "b", "Ça", "#d", "e|")) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(9))) for _ in range(80)]
    texts += [prose(rng, 30) for _ in range(5)]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _measures(t), t
        assert r["kept"] == (not r["base_failed"])


def test_line_frequency(spark):
    rng = random.Random(10)
    boiler = "subscribe to our letter today and read much more of this kind"
    texts = [f"{prose(rng, 12)}\n{boiler.upper() if i % 2 else boiler}\n{prose(rng, 12)}" for i in range(8)]
    texts += [f"{prose(rng, 1)}\n{boiler}\n{boiler}  \n{prose(rng, 1)}"]
    texts += ["\n".join(prose(rng, 12) for _ in range(3))] * 8  # copies: the same neighbours
    docs = frame(spark, texts, source=[None] * len(texts))
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs, max_docs=5).collect()}
    assert [i for i, kept in got.items() if not kept] == [8]
    kept = {r["doc_id"]: r["text"] for r in quality.filter_quality(docs, max_docs=5).collect()}
    assert sorted(kept) == [i for i in range(len(texts)) if i != 8]
    for i in range(8):
        assert kept[i] == "\n".join(texts[i].split("\n")[::2])
    assert kept[9] == texts[9]
    assert quality.filter_quality(docs.where("false")).count() == 0
    assert quality.quality(docs.where("false")).count() == 0


def test_line_frequency_of_blocks_and_copies(spark):
    rng = random.Random(21)
    block = [prose(rng, 9) for _ in range(5)]  # its inner lines always have the same neighbours
    line = prose(rng, 9)
    texts = ["\n".join([prose(rng, 30), *block, prose(rng, 30)]) for _ in range(6)]
    texts += ["\n".join([prose(rng, 4), *block])]
    texts += ["\n".join([prose(rng, 30), line, prose(rng, 30)]) for _ in range(5)]
    texts += ["\n".join([prose(rng, 30), line, prose(rng, 30)])] * 30
    few = prose(rng, 9)
    texts += ["\n".join([prose(rng, 30), few, prose(rng, 30)]) for _ in range(4)]
    texts += ["\n".join([prose(rng, 30), few, prose(rng, 30)])] * 30  # five texts: not above the limit
    docs = frame(spark, texts, source=[None] * len(texts))
    got = {r["doc_id"]: (r["n_boiler_words"], r["kept"]) for r in quality.quality(docs, max_docs=5).collect()}
    assert got == {i: (45, i != 6) if i < 7 else (9, True) if i < 42 else (0, True) for i in range(len(texts))}
    kept = {r["doc_id"]: r["text"] for r in quality.filter_quality(docs, max_docs=5).collect()}
    assert kept == {i: t if i >= 42 else "\n".join(x for x in t.split("\n") if x not in block and x != line) for i, t in enumerate(texts) if i != 6}


def test_packing(spark, library):
    rng = random.Random(12)
    texts = [None, "", "word " * 9000] + [prose(rng, rng.randrange(1, 900)) for _ in range(120)]
    rows = packing.pack(frame(spark, texts)).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            at += r["length"]
            assert r["length"] == 2048 or k == 0
        assert at == len(ids[i])
        assert len(own) == -(-at // 2048)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 2048) * 1.02 + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(13)
    for _ in range(50):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
        seed = rng.randrange(1, 20)
        chosen = packing.fullest(counts, seed, 50)
        used = dict(chosen)
        used[seed] -= 1
        assert all(n <= counts.get(s, 0) for s, n in used.items() if n)
        sums = {0}
        for s, n in counts.items():
            sums = {a + s * k for a in sums for k in range(n + 1)}
        assert sum(s * n for s, n in chosen.items()) == seed + max(a for a in sums if a <= 50 - seed)


def _repeats(texts, length=400):
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            places[t[s : s + length]].append((i, s))
    gone = [bytearray(len(t)) for t in texts]
    for own in places.values():
        if len(own) > 1:
            for i, s in own:
                gone[i][s : s + length] = b"\1" * length
    return gone


def test_window_hashes():
    flat = np.frombuffer(b"abcabcabcabcxabcabcabcabc", np.uint8)
    for width in (1, 5, 12, 25, 26):
        h = suffix_dedup.window_hashes(flat, width, 51).tolist()
        strings = [flat[i : i + width].tobytes() for i in range(len(flat) - width + 1)]
        assert len(h) == len(strings) and len(set(h)) == len(set(strings)) == len(set(zip(h, strings, strict=True)))


def test_hash_collisions_are_verified(monkeypatch):
    # all bytes alike to the hashes: every comparison by hashes is wrong
    monkeypatch.setattr(suffix_dedup, "_BYTE", np.zeros(256, np.uint64))
    rng = random.Random(30)
    width, mid = 40 + 8, 8
    for direct in (64, 2):
        monkeypatch.setattr(suffix_dedup, "DIRECT", direct)
        parts = ["".join(rng.choices("ab", k=width)).encode() for _ in range(4)]
        rows = [rng.choice(parts)[:k] + rng.choice(parts)[k:] for k in [rng.randrange(width) for _ in range(24)]]
        matrix = np.array([np.frombuffer(r, np.uint8) for r in rows])
        before, after = np.full(len(rows), mid), np.full(len(rows), width - mid)
        ext_l, ext_r = suffix_dedup.covered(matrix, before, after, np.array([0, len(rows)]), length=40, gram=32)
        places = Counter((s, r[s : s + 40]) for r in rows for s in range(9))
        for r, a, b in zip(rows, ext_l.tolist(), ext_r.tolist(), strict=True):
            hits = [s for s in range(9) if places[s, r[s : s + 40]] > 1]
            assert (a, b) == ((mid - min(hits), max(hits) + 40 - mid) if hits else (0, 0))


@pytest.mark.parametrize(("group", "length"), [(suffix_dedup.GROUP, 400), (3, 400), (suffix_dedup.GROUP, 250), (3, 250)])
def test_suffix_dedup(spark, group, length):
    rng = random.Random(14)
    passages = ["".join(rng.choices("abcdé ", k=n)) for n in (length - 10, length - 2, length + 20, 700, 1500)]
    texts = [None, "", "short", "x" * (length - 1), "ab" * 300, "y" * 1200]
    for _ in range(25):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcdé ", k=rng.randrange(300))) for _ in range(rng.randrange(1, 6))))
    texts += [texts[-1], texts[-1]]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, texts), group=group, length=length).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, _repeats(raw, length), strict=True)):
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()), i
        if sum(gone):
            assert r["text"] == left.decode("utf-8", "ignore")
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_sharding(spark):
    texts = ["é" * (i % 7) if i % 9 else None for i in range(3000)]
    keys = [None, 5, 5, *range(10, 3007)]
    rows = sharding.placement(frame(spark, texts, keys)).collect()
    assert len(rows) == 3000 and {r["law"] for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(100 < len(s) < 300 for s in slots.values())
    assert 80 < sum(r["grown_shard"] == 16 for r in rows) < 300
    by_key = {r["doc_id"]: r for r in rows}
    assert by_key[11]["size"] == len((texts[4] or "").encode()) + 1 and by_key[11]["text_crc32"] == zlib.crc32((texts[4] or "").encode())
    assert sharding.placement(frame(spark, [])).count() == 0


def test_tree_confines_movement(spark):
    from dataclasses import replace

    tree = sharding.balanced(16)
    region = tree.children[0]
    rack = region.children[0]
    heavy = replace(rack, children=(replace(rack.children[0], own_weight=3.0), *rack.children[1:]))
    changed = replace(tree, children=(replace(region, children=(heavy, *region.children[1:])), *tree.children[1:]))
    docs = frame(spark, ["t"] * 4000)
    moved = sharding.assign(sharding.assign(docs, tree, column="a"), changed, column="b").where("a <> b").collect()
    assert moved and all(r["b"] < 4 for r in moved)  # only into the region whose weight grew
    assert all(r["a"] >= 2 or r["b"] < 2 for r in moved if r["a"] < 4)


def test_components_of_few_edges(spark):
    """A small table is solved in a few jobs, with the result of the rounds."""
    rng = random.Random(9)
    nodes = rng.sample(range(10**9), 400)
    edges = spark.createDataFrame([*zip(nodes[:300], nodes[1:300]), *[(rng.choice(nodes[300:]), rng.choice(nodes[300:])) for _ in range(90)], (nodes[0], nodes[0])], "u long, v long")
    sc = spark.sparkContext
    sc.setJobGroup("few", "components")
    got = {tuple(r) for r in components.components(edges).select("id", "comp").collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    sc.setJobGroup("others", "")
    assert got == {tuple(r) for r in components.components(edges, few=0).select("id", "comp").collect()} and got
    assert jobs <= 6
    assert components.components(edges.where("false")).count() == 0
