"""Serial-number arithmetic on a 32-bit clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.samples import HALF, U32


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def ts_le(a, b) -> Column:
    """a is not after b: b lies less than half the clock ahead."""
    return (_lit(b) - _lit(a)).bitwiseAND(U32) < HALF


def in_range(t, t0, t1) -> Column:
    """Wrap-aware window; one of half the clock or more (or inverted) needs either bound only."""
    lower, upper = ts_le(t0, t), ts_le(t, t1)
    return F.when(ts_le(t0, t1), lower & upper).otherwise(lower | upper)
