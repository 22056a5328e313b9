"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another.  Each has a logistic model over
the words of a text, their beginnings (so that inflected forms are known) and the probabilities of the categories before it; what later
models are trained on are out-of-fold probabilities (each document's comes from a
model that hasn't seen it), what they get in use are those of the final models.
A model's words are weighted by their log-count ratio between the classes before
the fit, so that a few telling words stand out among thousands.  The threshold of
each category is the one with the best F1 out of fold.

The chain is fitted on at most ``TRAIN_ROWS`` labelled documents, chosen by a hash
of the key; words in fewer than ``MIN_DOCS`` of them are left out.  Every document
is scored, on its whole text, in one scan without a shuffle; what executors get is
the weights, bounded by the sample.

A null or empty text has no words and gets the models' intercepts; documents whose
label is null, or which aren't in the table, take no part in the fit; labels that
repeat a key count once (the largest), and so do texts that repeat one (the
smallest).  If a category has one class only in the
sample, its probability is that class's everywhere.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.flat import Words, pieces, text_buffer

TRAIN_ROWS = 6_000
MIN_DOCS = 3
FOLDS = 5
ROUNDS = 80
L2 = 2.0
#: Lengths of the word beginnings that are features beside the words.
STEMS = (4, 5)
#: Least log-count ratio (either way) of a feature that a model uses.
TELLING = 1.0

#: Punctuation counts as blank, letters as lower case.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words and word beginnings of each text, and offsets."""
    flat, offsets = text_buffer(column)
    words = Words(_PLAIN[flat], offsets, lower=True)
    unique = words.unique.to_pylist()
    tables = [np.fromiter((xxhash.xxh3_64_intdigest(w[:k], k or 17) for w in unique), np.uint64, len(unique)) for k in (None, *STEMS)]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.doc_offsets))
    value = np.concatenate([t[words.codes] for t in tables]) if len(words.codes) else np.zeros(0, np.uint64)
    doc = np.tile(doc, len(tables))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), np.bool_)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Linear:
    """A logistic model: a weight for each known word, one for each earlier category, an intercept."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, rows: np.ndarray, cols: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, weights=self.words[cols], minlength=n) + self.bias
        return sigmoid(z + before @ self.earlier)


def fit(rows: np.ndarray, cols: np.ndarray, n: int, width: int, before: np.ndarray, y: np.ndarray, use: np.ndarray) -> Linear:
    """A logistic fit on the documents in ``use`` (a mask)."""
    share = float(y[use].mean()) if use.any() else 0.0
    earlier = np.zeros(before.shape[1])
    if not use.any() or share in (0.0, 1.0):
        return Linear(np.zeros(width), earlier, 35.0 if share == 1.0 else -35.0)
    own = use[rows]
    rows, cols = rows[own], cols[own]
    yes = np.bincount(cols, weights=y[rows], minlength=width) + 1
    no = np.bincount(cols, weights=1 - y[rows], minlength=width) + 1
    ratio = np.log(yes / (y[use].sum() + 2)) - np.log(no / ((1 - y[use]).sum() + 2))
    ratio[np.abs(ratio) < TELLING] = 0.0
    told = ratio[cols] != 0
    rows, cols = rows[told], cols[told]
    value = ratio[cols]
    weight = np.zeros(width)
    bias = np.log(share / (1 - share))
    count = use.sum()
    state = [[np.zeros(width), np.zeros(width)], [np.zeros_like(earlier), np.zeros_like(earlier)], [np.zeros(1), np.zeros(1)]]
    for t in range(1, ROUNDS + 1):
        z = np.bincount(rows, weights=value * weight[cols], minlength=n) + before @ earlier + bias
        error = np.where(use, sigmoid(z) - y, 0.0)
        grads = (np.bincount(cols, weights=value * error[rows], minlength=width) + L2 * weight, before.T @ error + L2 * earlier, np.array([error.sum()]))
        steps = []
        for g, (m, v) in zip(grads, state, strict=True):
            g = g / count
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            steps.append(0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8))
        weight -= steps[0]
        earlier = earlier - steps[1]
        bias -= float(steps[2][0])
    return Linear(weight * ratio, earlier, bias)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 (the middle of its gap)."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0.0)) / 2)


@dataclass
class Chain:
    """Fitted models in the order of their categories."""

    categories: list[str]
    vocabulary: np.ndarray
    models: list[Linear]
    thresholds: list[float]

    def predict(self, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities, documents x categories."""
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(offsets))
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, value), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == value
            rows, cols = doc[known], at[known]
        else:
            rows, cols = doc[:0], doc[:0]
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack((out, model.predict(rows, cols, n, out)))
        return out


def fit_chain(value: np.ndarray, offsets: np.ndarray, labels: np.ndarray, categories: list[str], folds: int = FOLDS, min_docs: int = MIN_DOCS) -> Chain:
    """Fit on word sets and a 0/1 matrix of labels (documents x categories)."""
    n = len(offsets) - 1
    vocabulary, counts = np.unique(value, return_counts=True)
    vocabulary = vocabulary[counts >= min_docs]
    width = len(vocabulary)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    at = np.minimum(np.searchsorted(vocabulary, value), max(0, width - 1))
    known = vocabulary[at] == value if width else np.zeros(len(value), np.bool_)
    rows, cols = doc[known], at[known]
    fold = np.arange(n) % folds
    before, models, thresholds = np.zeros((n, 0)), [], []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        held_out = np.zeros(n)
        for f in range(folds):
            model = fit(rows, cols, n, width, before, y, fold != f)
            held_out[fold == f] = model.predict(rows, cols, n, before)[fold == f]
        models.append(fit(rows, cols, n, width, before, y, np.ones(n, np.bool_)))
        thresholds.append(best_threshold(held_out, y))
        before = np.column_stack((before, held_out))
    return Chain(categories, vocabulary, models, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], text: str = "text", key: str = "doc_id", limit: int = TRAIN_ROWS) -> Chain:
    """Fit a chain; ``categories``: name -> SQL expression over ``labels`` that is 0 or 1."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(*[F.max(F.expr(e).cast("int")).alias(f"y{i}") for i, e in enumerate(categories.values())])
    marks = marks.na.drop()
    body = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            value, at = word_sets(batch.column("t"))
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "t"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))], names=[*(name for name in batch.schema.names if name != "t"), "w"])

    # the bounded sample: its keys first, then only their texts
    chosen = marks.join(body.select("k").distinct(), "k").orderBy(F.xxhash64("k"), "k").limit(limit)
    ys = [f"y{i}" for i in range(len(categories))]
    # ``chosen`` has at most ``limit`` rows of numbers
    joined = body.join(F.broadcast(chosen), "k").groupBy("k", *ys).agg(F.min("t").alias("t"))
    fields = ", ".join(f"y{i} int" for i in range(len(categories)))
    kind = joined.schema["k"].dataType.simpleString()
    rows = joined.mapInArrow(sets, f"k {kind}, {fields}, w array<bigint>").toArrow().sort_by("k")
    lists = rows["w"].combine_chunks()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    value = np.asarray(lists.values).view(np.uint64)[offsets[0] : offsets[-1]]
    y = np.column_stack([np.asarray(rows[f"y{i}"]) for i in range(len(categories))]) if rows.num_rows else np.zeros((0, len(categories)))
    return fit_chain(value, offsets - offsets[0], y, list(categories))


def score(docs: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, p_<category> (double) and is_<category> (boolean) of each row, in the chain's order."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, "_text"):
            p = model.predict(*word_sets(batch.column("_text")))
            columns, names = [batch.column("_key")], [key]
            for k, name in enumerate(model.categories):
                columns += [pa.array(p[:, k]), pa.array(p[:, k] >= model.thresholds[k])]
                names += [f"p_{name}", f"is_{name}"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    fields = ", ".join(f"p_{c} double, is_{c} boolean" for c in chain.categories)
    return source.mapInArrow(run, f"`{key}` {source.schema['_key'].dataType.simpleString()}, {fields}")
