"""Text embeddings behind one interface: hashed terms, or a lexicon of word vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import text as X
from reviewlens.sources.files import parse_lexicon

#: A lexicon is sent to every task, so its artifact is bounded.
MAX_BYTES = 64 << 20


@dataclass(frozen=True)
class HashedTerms:
    """Signed hashing of words and pairs of words; needs no artifact."""

    dimensions: int = X.DIMENSIONS

    @property
    def identity(self) -> str:
        return f"hashed-terms-{self.dimensions}"

    def embed(self, text: Column) -> Column:
        """Unit vector of a text; null for a null text and one without terms."""
        return X.embedding(X.terms(text))


@dataclass(frozen=True, eq=False)
class Lexicon:
    """Sums of the vectors of a text's known words."""

    tokens: tuple[str, ...]
    vectors: np.ndarray
    name: str = "lexicon"

    @property
    def dimensions(self) -> int:
        return self.vectors.shape[1]

    @property
    def identity(self) -> str:
        return f"{self.name}-{len(self.tokens)}x{self.dimensions}"

    def embed(self, text: Column) -> Column:
        """Unit vector of a text; null without a known word, or if its words cancel out."""
        place, vectors = {t: i for i, t in enumerate(self.tokens)}, self.vectors

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(rows: pd.Series) -> pd.Series:
            out = []
            for words in rows:
                known = [place[w] for w in (() if words is None else words) if w in place]
                total = vectors[known].sum(axis=0) if known else np.zeros(0)
                norm = np.sqrt(total @ total)
                out.append(list(total / norm) if norm else None)
            return pd.Series(out)

        return run(X.tokens(text))


def backend(artifact: bytes | None) -> HashedTerms | Lexicon:
    """The lexicon of an artifact; hashed terms without one, or if it is broken, empty or too large."""
    if artifact is None or len(artifact) > MAX_BYTES:
        return HashedTerms()
    try:
        tokens, vectors = parse_lexicon(artifact)
    except (ValueError, UnicodeDecodeError):
        return HashedTerms()
    return Lexicon(tuple(tokens), vectors) if tokens else HashedTerms()


def embed_by_table(texts: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, v: unit vectors by a join with a lexicon that is a table (token, vec), of any size; texts without a known word have no row."""
    words = texts.select(key, F.explode(X.tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    parts = words.join(lexicon, "token").select(key, "n", F.posexplode("vec").alias("at", "x"))
    sums = parts.groupBy(key, "at").agg(F.sum(F.col("n") * F.col("x")).alias("s"))
    whole = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("p"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm")).where("norm > 0")
    return whole.select(key, F.transform("p", lambda x: x["s"] / F.col("norm")).alias("v"))
