"""The pipeline's stages on a small table, each against brute force over its own input."""

import random
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_operators import _components, _lines, _measures, _repeats, frame, prose


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(20)
    texts = [None, "", "too short"]
    block = "\n".join(prose(rng, 9) for _ in range(4))
    passage = prose(rng, 90)
    for i in range(14):
        body = "\n".join(prose(rng, 12) for _ in range(6))
        texts.append(body)
        if i % 3 == 0:
            words = body.split(" ")
            words[10] = "edited"
            texts.append(" ".join(words))
        if i % 3 == 1:
            texts.append(body.replace("\n", " "))  # other lines, the same words
        if i % 4 == 0:
            texts.append(body + "\n" + block)
        if i % 5 == 0:
            texts.append(prose(rng, 60) + " " + passage + " " + prose(rng, 60))
    texts += [texts[3], "spam " * 60]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{number}"))
        docs = spark.read.parquet(str(tmp_path / f"out{number}"))
        seen[name] = (before, docs)
        if number < 4:
            assert docs.columns == columns
    after = lambda name: {r["doc_id"]: r["text"] for r in seen[name][1].collect()}
    before = seen["quality rules"][0]
    assert after("quality rules") == {k: t for k, t in before.items() if not _measures(t)[-1]}
    before = seen["line dedup"][0]
    want = _lines(sorted(before.items()))
    assert after("line dedup") == {k: t for k, t in want.items() if t.strip() or t == before[k]}
    before = seen["near-dedup"][0]
    keys = sorted(before)
    labels, _ = _components([before[k] for k in keys], keys, 80)
    assert after("near-dedup") == {k: before[k] for k, c in zip(keys, labels, strict=True) if k == c}
    assert len(after("near-dedup")) < len(before)
    before = seen["suffix-array dedup"][0]
    keys = sorted(before)
    raw = [before[k].encode() for k in keys]
    want = {}
    for k, t, gone in zip(keys, raw, _repeats(raw, corpus_pipeline.PASSAGE_BYTES), strict=True):
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left.strip() or not any(gone):
            want[k] = left
    assert after("suffix-array dedup") == want and want != before
    rows = seen["packing"][1].collect()
    assert {r["doc_id"] for r in rows} == set(want)
    total = defaultdict(int)
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 2048


def test_repeated_rows(spark, tmp_path):
    rng = random.Random(22)
    a, b, c, d, e = ("\n".join(prose(rng, 12) for _ in range(8)) for _ in range(5))
    # 1: a row twice; 2: two texts, one a copy of 0's; 3: two near copies; 4: two texts, twice each; without a key: different texts
    rows = [(0, b), (1, a), (1, a), (2, c), (2, b), (3, d), (3, d.replace("\n", " ")), (4, e), (4, e), (4, e[::-1]), (4, e[::-1]), (None, a[::-1]), (None, b[::-1]), (None, None), (None, None)]
    docs = frame(spark, [t for _, t in rows], [k for k, _ in rows])
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(x for x in left if x[0] != 3 and x[0] is not None) == sorted([(0, b), (1, a), (2, c), (4, e), (4, e[::-1])])
    assert [t.replace("\n", " ") for k, t in left if k == 3] == [d.replace("\n", " ")]
    assert sorted((t or "" for k, t in left if k is None)) == sorted(["", a[::-1], b[::-1]])
    docs.where("doc_id < 4").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
