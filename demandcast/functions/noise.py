"""Repeatable Gaussian noise from a hash of row keys (Box-Muller)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_53 = float(2 ** 53)


def uniform_from_hash(cols, seed: int, stream: int) -> Column:
    """A uniform in (0, 1) from ``xxhash64`` of the columns, a seed and a stream id."""
    h = F.xxhash64(*[F.col(c) for c in cols], F.lit(int(seed)), F.lit(int(stream)))
    return (F.pmod(h, F.lit(2 ** 53)).cast("double") + F.lit(0.5)) / F.lit(_TWO_53)


def gaussian_noise(cols, seed: int = 42, stream: int = 0) -> Column:
    """N(0, 1) per row; the same keys, seed and stream always give the same draw."""
    u1 = uniform_from_hash(cols, seed, 2 * stream)
    u2 = uniform_from_hash(cols, seed, 2 * stream + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
