"""Column-expression helpers. All are built-in Spark expressions, so they stay
inside whole-stage code generation; none needs a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(c: Column, digits: int) -> Column:
    """Round the way numpy does: scale, round half to even, unscale.

    ``F.bround`` rounds the exact decimal value of the double instead, which
    differs on values such as 0.35 (numpy and this helper give 0.4).
    """
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def mean_of_decimals(c: Column, digits: int = 1) -> Column:
    """Mean of values that carry ``digits`` decimals, rounded to ``digits``
    (half to even), computed on the exact scaled integers so the result does
    not depend on the order in which partitions are summed."""
    scale = float(10 ** digits)
    return F.rint(F.sum(F.rint(c * scale)) / F.count(c)) / scale


def median_of_decimals(c: Column, digits: int = 1) -> Column:
    """Interpolated median of values with ``digits`` decimals, rounded to
    ``digits`` (half to even), computed on the scaled integers."""
    scale = float(10 ** digits)
    return F.rint(F.median(F.rint(c * scale))) / scale


def js_round(c: Column, digits: int) -> Column:
    """Display rounding of the browser code (``toFixed``): half away from zero."""
    return F.round(c, digits)


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """Null-preserving clip. Spark's least/greatest skip nulls, numpy keeps NaN."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def clip01(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


#: Hexadecimal digits of an md5 digest that make a draw: 52 bits, exact as a long and as a double.
DRAW_DIGITS = 13


def draw_bits(seed: int, *cols: Column) -> Column:
    """A counter-based draw, whole number below 2^52: the leading digits of the md5 of seed
    and key columns. Any engine computes the same, whatever the order or layout of rows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("long")


def hash_uniform(seed: int, *cols: Column) -> Column:
    """U[0,1) from a draw on key columns: stable under retries and repartitioning
    (unlike ``rand()``)."""
    return draw_bits(seed, *cols).cast("double") / F.lit(float(16 ** DRAW_DIGITS))


def hash_normal(seed: int, *cols: Column) -> Column:
    """N(0,1) by Box-Muller over two independent draws."""
    u1 = hash_uniform(seed, *cols)
    u2 = hash_uniform(seed + 7919, *cols)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (nulls do not count), as bigint."""
    return F.count(F.when(cond, F.lit(1))).cast("long")


def contains_ci(c: Column, pattern_alternation: str) -> Column:
    """Case-insensitive regex search; null text never matches (pandas ``na=False``)."""
    return F.coalesce(c.rlike("(?i)" + pattern_alternation), F.lit(False))


def not_equal_null_true(c: Column, value) -> Column:
    """pandas ``ne``: a missing value is *not equal* to anything."""
    return ~c.eqNullSafe(F.lit(value))
