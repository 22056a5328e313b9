"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Texts are cut into words on their UTF-8 bytes by vectorised class rules (the
splitting pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|
\\s+(?!\\S)|\\s+``), Arrow's dictionary encoding finds the distinct words, and
only those are merged: the symbols of many words lie in one flat array; a round
finds each word's lowest-ranked neighbouring pair (ranks of pairs come by binary
search over the sorted pair keys) and merges all its occurrences, until no word
has a pair left.  Ids of the words then go back to the texts by one gather.

Bounds: ``CHUNK_BYTES`` of text at once, and a cache of at most about
``CACHE_WORDS`` words per Python worker, the first that it meets (the cache
changes no result).
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.flat import binary_array, pieces, ranges, text_buffer

CACHE_WORDS = 400_000
OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def character_classes(path: str) -> bytes:
    """Compressed table: class of every code point, as the tokenizer's own pattern engine has it.

    Candidates come from ``unicodedata``; those that the installed engine (of
    another Unicode version) doesn't count as letters or numbers are dropped.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    for kind, beside in ((LETTER, "a"), (NUMBER, "1")):
        points = np.flatnonzero(table == kind)
        ends = {end for _, (_, end) in split("".join(f"{beside}{chr(c)}{beside}\n" for c in points))}
        # each candidate takes four places; the run beside-c-beside is one piece only if no piece ends inside it
        apart = [c for i, c in enumerate(points.tolist()) if 4 * i + 1 in ends or 4 * i + 2 in ends]
        table[apart] = OTHER
    table[[0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x09, 0x0E), *range(0x2000, 0x200B)]] = WHITE
    return zlib.compress(table.tobytes())


class Vocabulary:
    """Merge table and token bytes of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str, classes: bytes):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = dict(zip(plain, map(chr, plain), strict=True))
        for n, b in enumerate(b for b in range(256) if b not in shown):
            shown[b] = chr(256 + n)
        byte_of = {c: b for b, c in shown.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = sorted((t["content"].encode(), t["id"]) for t in spec["added_tokens"])
        size = max([*vocab.values(), *(i for _, i in self.special)]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for content, i in self.special:
            self.token_bytes[i] = content
        self.tokens = pa.array(self.token_bytes, pa.large_binary())
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.size = size
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), merged.astype(np.int32)
        one = np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        self.byte_ranks = self._ranks(*one)  # of all pairs of single bytes, for the first round
        self.cached = pa.array([], pa.large_binary())
        self.cached_ids = np.zeros(0, np.int32)
        self.cached_counts = np.zeros(0, np.int32)

    # -- splitting -----------------------------------------------------------------

    def _plain_words(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where words start (documents always start one)."""
        n = len(flat)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[:256][flat]
        wide = np.flatnonzero(flat >= 0xC0)
        rest = (flat & 0xC0) == 0x80
        if len(wide):
            tail = np.concatenate((flat, np.zeros(3, np.uint8)))
            b0, b1, b2, b3 = (tail[wide + k].astype(np.int32) for k in range(4))
            b1, b2, b3 = b1 & 0x3F, b2 & 0x3F, b3 & 0x3F
            points = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
            own = self.classes[np.minimum(points, 0x10FFFF)]
            for k in range(4):  # continuation bytes have the class of their character
                there = wide[wide + k < n] + k
                there_own = own[: len(there)]
                ok = rest[there] if k else slice(None)
                kind[there[ok]] = there_own[ok]
                if k:
                    wide, own = there[ok] - k, there_own[ok]
        doc_start = np.zeros(n + 1, np.bool_)
        doc_start[offsets] = True
        doc_start[n] = True
        start = doc_start[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # last character of a white run, with something after it in the same document
        last = kind == WHITE
        last[:-1] &= ~last[1:]
        last &= ~doc_start[1:]
        at = np.flatnonzero(last)
        while (back := rest[at]).any():
            at = at - back
        start[at] = True
        joins = at[flat[at] == 0x20]
        start[joins + 1] = False
        # contractions: a lone apostrophe that begins its word
        quote = np.flatnonzero((flat == 0x27) & start)
        if len(quote):
            padded = np.concatenate((flat, np.zeros(3, np.uint8)))
            ends = np.concatenate((doc_start, np.ones(3, np.bool_)))
            c1, c2 = padded[quote + 1], padded[quote + 2]
            one = ~ends[quote + 1] & ((c1 == 0x73) | (c1 == 0x74) | (c1 == 0x6D) | (c1 == 0x64))
            two = ~ends[quote + 1] & ~ends[quote + 2] & (((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C)))
            for hit, width in ((one, 2), (two, 3)):
                q = quote[hit]
                start[q + 1] = False
                after = q + width
                start[after[after < n]] = True
        return np.flatnonzero(start)

    def split(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, ids of those that are special tokens (else -1), and word offsets of documents."""
        spots = []
        raw = None
        for content, i in self.special:
            raw = flat.tobytes() if raw is None else raw
            at = raw.find(content)
            while at >= 0:
                spots.append((at, len(content), i))
                at = raw.find(content, at + len(content))
        spots.sort()
        if spots:
            where = np.array([s[0] for s in spots])
            inside = np.searchsorted(offsets, where, "right")
            sizes = np.array([s[1] for s in spots])
            spots = [s for s, ok in zip(spots, offsets[inside] >= where + sizes, strict=True) if ok]
        cuts = offsets if not spots else np.unique(np.concatenate((offsets, [s[0] for s in spots], [s[0] + s[1] for s in spots])))
        starts = self._plain_words(flat, cuts)
        special = np.full(len(starts), -1, np.int64)
        if spots:
            drop = np.zeros(len(starts), np.bool_)
            for at, size, i in spots:
                a, b = np.searchsorted(starts, [at, at + size])
                drop[a + 1 : b] = True
                special[a] = i
            starts, special = starts[~drop], special[~drop]
        return starts, special, np.searchsorted(starts, offsets)

    # -- merging -------------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search; a rank no merge has where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(len(self.keys)))

    def merge(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their bytes, and how many each has."""
        none = len(self.keys)
        words = len(offsets) - 1
        symbols = self.byte_ids[flat]
        word = np.repeat(np.arange(words, dtype=np.int32), np.diff(offsets))
        rank = None
        done_ids, done_words = [], []
        while len(symbols):
            same = word[1:] == word[:-1]
            if rank is None:
                rank = np.full(len(symbols), none, np.int32)
                rank[:-1] = np.where(same, self.byte_ranks[flat[:-1].astype(np.int32) << 8 | flat[1:]], np.int32(none))
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            lowest = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbols)))
            open_word = np.repeat(lowest < none, counts)
            if not open_word.all():
                done_ids.append(symbols[~open_word])
                done_words.append(word[~open_word])
                symbols, word, rank = symbols[open_word], word[open_word], rank[open_word]
                alive = lowest < none
                lowest, counts = lowest[alive], counts[alive]
                if not len(symbols):
                    break
            target = np.repeat(lowest, counts)
            hit = rank == target
            # in a run of overlapping hits (a a a) every second one merges, from the left
            if (hit[1:] & hit[:-1]).any():
                at = np.flatnonzero(hit)
                begins = np.concatenate(([True], np.diff(at) != 1))
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                hit[at[place % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), np.bool_)
            keep[at + 1] = False
            fresh = np.zeros(len(symbols), np.bool_)
            fresh[at] = True
            symbols, word, rank, fresh = symbols[keep], word[keep], rank[keep], fresh[keep]
            # only pairs beside a merged symbol have a new rank
            fresh[:-1] |= fresh[1:]
            at = np.flatnonzero(fresh)
            inner = at[at < len(symbols) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[at] = none
            rank[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
        owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int32)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=words)

    # -- texts ---------------------------------------------------------------------

    def _word_ids(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of the given distinct words, through the cache."""
        known = np.asarray(pc.index_in(unique, value_set=self.cached).fill_null(-1), dtype=np.int64)
        new = np.flatnonzero(known < 0)
        table, counts = self.cached_ids, self.cached_counts
        if len(new):
            words = unique.take(pa.array(new))
            ids, new_counts = self.merge(*text_buffer(words))
            known[new] = len(self.cached) + np.arange(len(new))
            table, counts = np.concatenate((table, ids)), np.concatenate((counts, new_counts.astype(np.int32)))
            if len(self.cached) < CACHE_WORDS:
                self.cached = pa.concat_arrays([self.cached, words])
                self.cached_ids, self.cached_counts = table, counts
        starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        own = counts[known].astype(np.int64)
        return table[ranges(starts[known], own)].astype(np.int64), own

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of a batch of texts, and the offsets of its documents in them."""
        starts, special, doc_words = self.split(flat, offsets)
        coded = binary_array(flat, np.append(starts, len(flat))).dictionary_encode()
        codes = np.asarray(coded.indices, dtype=np.int64)
        ids, counts = self._word_ids(coded.dictionary)
        first = np.concatenate(([0], np.cumsum(counts)))
        per_word = counts[codes] if len(codes) else np.zeros(0, np.int64)
        begin = first[codes] if len(codes) else np.zeros(0, np.int64)
        marked = np.flatnonzero(special >= 0)
        if len(marked):
            # specials go at the end of the id table, one each
            table = np.concatenate((ids, special[marked]))
            begin[marked] = len(ids) + np.arange(len(marked))
            per_word[marked] = 1
            ids = table
        out = ids[ranges(begin, per_word)].astype(np.uint32)
        total = np.concatenate(([0], np.cumsum(per_word)))
        return out, total[doc_words]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of ``ids``, and document offsets in them; special tokens are kept."""
        taken = self.tokens.take(pa.array(ids.astype(np.int64)))
        flat, token_offsets = text_buffer(taken)
        return flat, token_offsets[offsets]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str, classes: bytes) -> Vocabulary:
    """One vocabulary (and cache) per Python worker."""
    return Vocabulary(path, classes)


def encode_decode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Encode each text and decode its ids.

    Returns ``key``, n_tokens, ids_sha256 (decimal ids joined by commas), ids
    digested only, decoded_sha256, n_bytes and exact (the decoded bytes are the
    text's).  One row per input row: a null text counts as empty, repeated rows
    and null keys pass through, an empty table gives no rows, other columns are
    ignored.  One scan, no shuffle.
    """
    path = path or default_vocabulary()
    classes = character_classes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, classes)
        decimal = pa.array([b"%d," % i for i in range(vocab.size)], pa.large_binary())
        for batch in pieces(batches, "_text"):
            flat, offsets = text_buffer(batch.column("_text"))
            ids, at = vocab.encode(flat, offsets)
            digits, digit_offsets = text_buffer(decimal.take(pa.array(ids.astype(np.int64))))
            digit_at = digit_offsets[at]
            back, back_at = vocab.decode(ids, at)
            shown, plain, exact = [], [], []
            digits_view, back_view, flat_view = memoryview(digits), memoryview(back), memoryview(np.ascontiguousarray(flat))
            for i in range(batch.num_rows):
                a, b = digit_at[i], digit_at[i + 1]
                shown.append(hashlib.sha256(digits_view[a : max(a, b - 1)]).hexdigest())
                text_bytes = bytes(back_view[back_at[i] : back_at[i + 1]])
                plain.append(hashlib.sha256(text_bytes.decode("utf-8", "replace").encode()).hexdigest())
                exact.append(text_bytes == flat_view[offsets[i] : offsets[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(np.diff(at), pa.int64()), pa.array(shown), pa.array(plain), pa.array(np.diff(offsets), pa.int64()), pa.array(exact)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "exact"],
            )

    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, exact boolean")


def encode_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """The ids themselves: ``key`` and ids array<int>.  Nulls and repeats as in ``encode_decode``."""
    path = path or default_vocabulary()
    classes = character_classes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, classes)
        for batch in pieces(batches, "_text"):
            ids, at = vocab.encode(*text_buffer(batch.column("_text")))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), lists], names=[key, "ids"])

    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return source.mapInArrow(run, f"`{key}` {source.schema['_key'].dataType.simpleString()}, ids array<int>")


def decode_ids(tokens: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Texts of id arrays: ``key`` and text.  A null array gives a null text; bytes that aren't UTF-8 become U+FFFD."""
    path = path or default_vocabulary()
    classes = character_classes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, classes)
        for batch in batches:
            texts = [None if row is None else b"".join(vocab.token_bytes[i] for i in row).decode("utf-8", "replace") for row in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(texts, pa.string())], names=[key, "text"])

    source = tokens.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    return source.mapInArrow(run, f"`{key}` {source.schema['_key'].dataType.simpleString()}, text string")
