"""Pluggable model functions and their deterministic defaults.

An encoder maps a string column to array<float>; a reranker two string columns to a double; a verifier a
DataFrame of shortlisted papers to one with verdict and confidence. External models are plugged in as
Arrow-batched functions of the same signature; persist or checkpoint before a verifier that calls out, so
that a retry does not repeat the call.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]
Verifier = Callable[[DataFrame], DataFrame]


def hashed_encoder(dim: int = 128, unit: bool = True) -> Encoder:
    """Vectors of hashed token counts: a token adds 1 at its SHA-256 prefix mod dim; null gives zeros.

    unit: scaled to length 1. Where a cosine follows anyway, counts are exact and the scaled ones rounded.
    """

    def encode(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}
        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                if w not in slots:
                    slots[w] = int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % dim
                v[slots[w]] += 1
            n = float(np.linalg.norm(v))
            out.append(v / n if n and unit else v)
        return pd.Series(out)

    return F.pandas_udf(encode, "array<float>")


def zero_reranker(query: Column, passage: Column) -> Column:
    return F.when(query.isNotNull() | passage.isNotNull(), F.lit(0.0)).otherwise(F.lit(0.0))


def overlap_reranker(query: Column, passage: Column) -> Column:
    """Share of the query's tokens that the passage holds."""
    from folioscope.functions.text import tokens

    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(passage))) / F.size(q)).otherwise(0.0)


def threshold_verifier(satisfied: float = 0.6, partial: float = 0.3) -> Verifier:
    """Stand-in without a model: verdict and confidence from the score before verification."""

    def verify(shortlist: DataFrame) -> DataFrame:
        s = F.col("pre_score")
        verdict = F.when(s >= satisfied, "satisfied").when(s >= partial, "partial").otherwise("rejected")
        return shortlist.withColumn("verdict", verdict).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))

    return verify
