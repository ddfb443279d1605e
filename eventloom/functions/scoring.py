"""Ranking formulas: BM25, adaptive sigmoid, recency, cosine, fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (most tokens of a query, slope, centre) of the sigmoid's regimes.
REGIMES = ((3, 15.0, -7.0), (6, 10.0, -10.0), (9, 8.0, -12.0), (15, 6.0, -14.0), (math.inf, 4.0, -16.0))
RECENCY_DAYS = 30.0
#: Weights of the fused score, and the gate below which a candidate goes.
SEMANTIC, LEXICAL, SUBJECT, GATE = 0.65, 0.35, 0.20, 0.1


def regime(tokens: int) -> tuple[float, float]:
    return next((k, x0) for most, k, x0 in REGIMES if tokens <= most)


def sigmoid(raw: Column, slope: Column, centre: Column) -> Column:
    """R5 of a raw (negative) BM25 score."""
    return 1 / (1 + F.exp(-((-raw) - centre) / slope))


def regime_columns(tokens: Column) -> tuple[Column, Column]:
    slope, centre = F.lit(REGIMES[-1][1]), F.lit(REGIMES[-1][2])
    for most, k, x0 in reversed(REGIMES[:-1]):
        slope, centre = F.when(tokens <= int(most), F.lit(k)).otherwise(slope), F.when(tokens <= int(most), F.lit(x0)).otherwise(centre)
    return slope, centre


def age_days(at: Column, now: str) -> Column:
    utc = lambda c: F.unix_micros(c.cast("timestamp"))
    return (utc(F.lit(now).cast("timestamp_ntz")) - utc(at)) / 86_400_000_000.0


def recency(at: Column, now: str, days: float = RECENCY_DAYS) -> Column:
    """An e-folding time; zero disables."""
    return F.exp(-age_days(at, now) / max(0.001, days)) if days else F.lit(1.0)


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5)))


def bm25_term(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors, clamped to [0, 1]; vectors of unequal length raise."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norms)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))


def idf_of(n: float, df: float) -> float:
    """R1 on the driver, where a table of bounds decides what is read."""
    return max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))


def bm25_of(tf: float, dl: float, avgdl: float) -> float:
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
