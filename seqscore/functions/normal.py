"""The inverse normal distribution as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqscore.functions.stats_math import _A, _B, _C, _D

LOW = 0.02425  # below it, and as far from 1, the tails have a formula of their own


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The normal quantile of a share p, to a relative error of 1.2e-9 (the coefficients of
    ``stats_math.ndtri``); infinite at 0 and 1, null outside."""
    q = p - F.lit(0.5)
    r = q * q
    middle = _poly(r, _A) * q / _poly(r, [*_B, 1.0])
    low, high = F.sqrt(F.lit(-2.0) * F.log(p)), F.sqrt(F.lit(-2.0) * F.log1p(-p))
    tail = lambda v: _poly(v, _C) / _poly(v, [*_D, 1.0])
    return (F.when((p < 0) | (p > 1), F.lit(None).cast("double")).when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf")))
            .when(p <= LOW, tail(low)).when(p >= 1 - LOW, -tail(high)).otherwise(middle))
