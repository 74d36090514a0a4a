"""Seeded hashed uniforms: the same number for the same key on any partitioning and any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hashed_long(seed, *keys) -> Column:
    """52-bit integer from md5('seed|key|key...'); null keys hash as empty text."""
    parts = [F.lit(str(seed))] + [F.coalesce(as_col(k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def hashed_unit(seed, *keys) -> Column:
    """Uniform in (0, 1)."""
    return (hashed_long(seed, *keys) + F.lit(0.5)) / F.lit(float(2**HASH_BITS))


def hashed_normal(seed, *keys) -> Column:
    """Standard normal by Box-Muller from two hashed uniforms."""
    u, v = hashed_unit(f"{seed}a", *keys), hashed_unit(f"{seed}b", *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * 3.141592653589793) * v)
