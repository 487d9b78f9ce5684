"""Whole-number keys in the order of doubles, for cutting their whole range into ranges without looking at the data.

A double's key has ``BITS`` binary digits: its first ones name a range, more of them a
finer one. A range's width follows its values' size (one key: 1e-11 of the value), so
that ranges hold few distinct doubles whatever the data's scale.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 48
#: Values nearer to 0 than this share one key.
TINY = 1e-300
#: Above the logarithm of any double's ratio to ``TINY``.
TOP = 1401.0


def order_key(x: Column) -> Column:
    """A long that never falls as ``x`` rises; -inf, +inf and NaN (greatest, as Spark sorts it) have keys of their own."""
    size = F.log(F.abs(x) + TINY) - F.log(F.lit(TINY))
    at = F.floor((F.signum(x) * size + TOP) * (2.0 ** BITS / (2 * TOP))).cast("long")
    return (F.when(F.isnan(x), F.lit((1 << BITS) + (1 << BITS - 8))).when(x == math.inf, F.lit(1 << BITS))
            .when(x == -math.inf, F.lit(-1)).otherwise(at))


def leading(key: Column, digits: int) -> Column:
    """The first so many binary digits of a key."""
    return F.shiftright(key, BITS - digits)
