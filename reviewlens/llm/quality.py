"""Quality rules: measures of each text and the cross-document frequency of lines.

Measures (words are ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars, n_symbols,
n_dup_lines, n_repeat_words; base_failed where there are under ``MIN_WORDS`` words
or over a fifth of them lie in repeated five-word windows.

Line frequency: each line is normalised (A-Z lower, white space to single blanks)
and hashed; for each host (``source``) the distinct texts that have the line are
counted, so exact copies of a document count once.  A line in more than
``MAX_DOCS`` of them is boilerplate and is removed, whatever stands around it.  A
document whose rest is under a fifth of its words is depleted and is rejected.

A null text has no words (and fails), a null host is a host of its own, an empty table gives no rows, other columns pass through
``filter_quality``; helper columns are named with a leading ``__q_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.flat import Words, binary_array, mix64, pieces, ranges, seeds, segment_sum, text_buffer
from reviewlens.llm.line_dedup import identity
from reviewlens.llm.store import written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_DOCS = 100
MIN_LEFT_PERCENT = 20
WINDOW = 5

_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = 0x0A


def repeat_words(codes: np.ndarray, doc_offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each document that lie in a window of words found at least twice in it."""
    counts = np.diff(doc_offsets)
    n = np.maximum(counts - window + 1, 0)
    starts = ranges(doc_offsets[:-1], n)
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), n)
    salt = seeds(window, 5)
    with np.errstate(over="ignore"):
        word = mix64(codes.astype(np.uint64) + np.uint64(1))
        value = np.zeros(len(starts), np.uint64)
        for k in range(window):
            value += mix64(word[starts + k] ^ salt[k])
        value = mix64(value ^ mix64(doc.astype(np.uint64) + np.uint64(77)))
    order = np.argsort(value, kind="stable")
    v, d = value[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    hit = np.zeros(len(v), np.bool_)
    hit[1:] |= same
    hit[:-1] |= same
    at = starts[order[hit]]
    delta = np.zeros(len(codes) + window + 1, np.int32)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + window, -1)
    return segment_sum((np.cumsum(delta)[: len(codes)] > 0).astype(np.int64), doc_offsets)


class Lines:
    """Lines of a batch of texts: document, place, words, exact code and normalised hash."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, words: Words):
        newline = np.flatnonzero(flat == _NEWLINE)
        sizes = np.diff(offsets)
        # a newline that ends its document is followed by an empty line of that document
        doc_of_newline = np.searchsorted(offsets, newline, "right") - 1
        owner = np.concatenate((np.flatnonzero(sizes > 0), doc_of_newline))
        start = np.concatenate((offsets[:-1][sizes > 0], newline + 1))
        order = np.lexsort((start, owner))
        self.docs, self.starts = owner[order], start[order]
        last = np.append(self.docs[1:] != self.docs[:-1], True) if len(self.docs) else np.zeros(0, np.bool_)
        ends = np.empty(len(self.starts), np.int64)
        if len(self.starts):
            ends[:-1] = self.starts[1:] - 1
            ends[last] = offsets[1:][self.docs[last]]
        self.ends = ends
        first = np.searchsorted(words.starts, self.starts)
        self.word_offsets = first
        self.n_words = np.searchsorted(words.starts, ends) - first
        self.place = np.arange(len(self.docs)) - np.searchsorted(self.docs, self.docs)


def line_hashes(lines: Lines, words: Words) -> np.ndarray:
    """Hash of each line's normalised words in order; 0 where it has none."""
    per_word = words.unique_hashes(3)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    within = ranges(np.zeros(len(lines.n_words), np.int64), lines.n_words)
    flat_at = ranges(lines.word_offsets, lines.n_words)
    with np.errstate(over="ignore"):
        value = mix64(per_word[flat_at] + mix64(within.astype(np.uint64) + np.uint64(9)))
    out = np.zeros(len(lines.n_words), np.uint64)
    full = np.flatnonzero(lines.n_words > 0)
    if len(full):
        begin = np.cumsum(lines.n_words) - lines.n_words
        out[full] = mix64(np.add.reduceat(value, begin[full]) ^ np.uint64(1))
    return out


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """__q_k, __q_a, __q_b (the document), __q_h (host), the measures, base_failed and its lines.

    lines: array of (at, line, words) for the first place of each normalised line.
    """
    source = identity(docs, text, key, "__q_").select("__q_k", "__q_a", "__q_b", F.xxhash64(F.col(host).isNull(), host).alias("__q_h"), F.col(text).alias("__q_text"))
    keep = ["__q_k", "__q_a", "__q_b", "__q_h"]
    kind = pa.struct([("at", pa.int32()), ("line", pa.int64()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__q_text"):
            flat, offsets = text_buffer(batch.column("__q_text"))
            words = Words(flat, offsets)
            n_words = np.diff(words.doc_offsets)
            chars = segment_sum(((words.bytes & 0xC0) != 0x80).astype(np.int64), np.append(np.cumsum(words.lengths) - words.lengths, len(words.bytes))[words.doc_offsets])
            symbols = segment_sum(_SYMBOL[flat].astype(np.int64), offsets)
            lines = Lines(flat, offsets, words)
            kept = flat != _NEWLINE
            at = np.concatenate(([0], np.cumsum(kept)))
            sizes = lines.ends - lines.starts
            code = np.asarray(binary_array(flat[kept], np.append(at[lines.starts], at[-1])).dictionary_encode().indices, dtype=np.int64) if len(sizes) else np.zeros(0, np.int64)
            worded = np.flatnonzero(lines.n_words > 0)
            order = worded[np.lexsort((worded, code[worded], lines.docs[worded]))]
            again = (code[order][1:] == code[order][:-1]) & (lines.docs[order][1:] == lines.docs[order][:-1])
            dup_lines = np.bincount(lines.docs[order][1:][again], minlength=len(n_words))
            repeats = repeat_words(words.codes, words.doc_offsets)
            # normalised lines with words: those of the lower-cased text
            lower = Words(flat, offsets, lower=True)
            hashed = line_hashes(lines, lower)
            docs_at, value = lines.docs[worded], hashed[worded]
            order = np.lexsort((worded, value, docs_at))
            fresh = np.ones(len(order), np.bool_)
            fresh[1:] = (value[order][1:] != value[order][:-1]) | (docs_at[order][1:] != docs_at[order][:-1])
            # words of all its places count with the first
            group = np.cumsum(fresh) - 1
            total = np.bincount(group, weights=lines.n_words[worded][order], minlength=int(fresh.sum())).astype(np.int64) if len(order) else np.zeros(0, np.int64)
            first = order[fresh]
            bounds = np.searchsorted(docs_at[first], np.arange(len(n_words) + 1))
            items = pa.StructArray.from_arrays(
                [pa.array(lines.place[worded][first], pa.int32()), pa.array(value[first].view(np.int64)), pa.array(total, pa.int32())], fields=list(kind)
            )
            failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
            values = (n_words, chars, symbols, dup_lines, repeats)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(v, pa.int64()) for v in values), pa.array(failed), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)],
                names=[*keep, *_MEASURES, "base_failed", "lines"],
            )

    key_type = source.schema["__q_k"].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in _MEASURES)
    return source.mapInArrow(run, f"__q_k {key_type}, __q_a long, __q_b long, __q_h long, {fields}, base_failed boolean, lines array<struct<at: int, line: long, words: int>>")


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_docs: int = MAX_DOCS) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs``: document, measures, base_failed, n_boiler_words, kept; and the boilerplate (__q_h, line)."""
    measured = written(measures(docs, text, key, host).withColumn("__q_row", F.monotonically_increasing_id()), "measures")
    lines = measured.select("__q_row", "__q_a", "__q_b", "__q_h", F.explode("lines").alias("l")).select("__q_row", "__q_a", "__q_b", "__q_h", "l.line", "l.words")
    texts = lines.select("__q_h", "line", "__q_a", "__q_b").distinct()
    found = texts.groupBy("__q_h", "line").agg(F.count("*").alias("n_texts"))
    boiler = written(found.where(F.col("n_texts") > max_docs), "boilerplate")
    lost = lines.join(boiler.select("__q_h", "line"), ["__q_h", "line"]).groupBy("__q_row").agg(F.sum("words").alias("lost"))
    rows = measured.join(lost, "__q_row", "left").withColumn("n_boiler_words", F.coalesce("lost", F.lit(0)))
    depleted = (F.col("n_boiler_words") > 0) & (100 * (F.col("n_words") - F.col("n_boiler_words")) < MIN_LEFT_PERCENT * F.col("n_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("lost", "__q_row"), boiler


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """``key``, the measures, base_failed, kept and n_boiler_words of every row."""
    rows, _ = judged(docs, text, key, host, max_docs)
    return rows.select(F.col("__q_k").alias(key), *_MEASURES, "base_failed", "kept", "n_boiler_words")


def filter_quality(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``docs`` that are kept, their boilerplate lines removed, in the same columns."""
    rows, boiler = judged(docs, text, key, host, max_docs)
    bad = rows.where("kept").select("__q_k", "__q_a", "__q_b", "__q_h", F.explode("lines").alias("l")).select("__q_k", "__q_a", "__q_b", "__q_h", "l.line")
    bad = bad.join(boiler.select("__q_h", "line"), ["__q_h", "line"]).groupBy("__q_k", "__q_a", "__q_b", "__q_h").agg(F.collect_set("line").alias("gone"))
    ruling = rows.where("NOT kept").select("__q_k", "__q_a", "__q_b", "__q_h", F.lit(None).cast("array<bigint>").alias("gone"), F.lit(True).alias("out")).distinct()
    ruling = written(ruling.unionByName(bad.withColumn("out", F.lit(False))), "quality-rulings")
    ruling = ruling.select(*[F.col(c).alias(f"{c}v") for c in ("__q_k", "__q_a", "__q_b", "__q_h")], F.col("gone").alias("__q_gone"), F.col("out").alias("__q_out"))
    left = identity(docs, text, key, "__q_").withColumn("__q_h", F.xxhash64(F.col(host).isNull(), host))
    same = F.col("__q_k").eqNullSafe(F.col("__q_kv")) & (F.col("__q_a") == F.col("__q_av")) & (F.col("__q_b") == F.col("__q_bv")) & (F.col("__q_h") == F.col("__q_hv"))
    columns = docs.columns
    joined = left.join(ruling, same, "left").where("NOT coalesce(__q_out, false)").select(*[F.col(f"`{c}`") for c in columns], "__q_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            gone = batch.column("__q_gone")
            texts = batch.column(text)
            marked = [i for i in range(batch.num_rows) if gone[i].is_valid]
            if marked:
                new = texts.to_pylist()
                flat, offsets = text_buffer(texts.take(pa.array(marked)))
                lower = Words(flat, offsets, lower=True)
                lines = Lines(flat, offsets, lower)
                hashed = line_hashes(lines, lower).view(np.int64)
                for k, i in enumerate(marked):
                    a, b = np.searchsorted(lines.docs, [k, k + 1])
                    out = np.isin(hashed[a:b], np.asarray(gone[i].values)) & (lines.n_words[a:b] > 0)
                    new[i] = "\n".join(line for line, drop_it in zip(new[i].split("\n"), out.tolist(), strict=True) if not drop_it)
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text else batch.column(c) for c in columns], names=columns)

    return joined.mapInArrow(run, docs.schema)
