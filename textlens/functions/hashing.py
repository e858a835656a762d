"""Repeatable randomness: a uniform number that depends only on its arguments.

``rand(seed)`` depends on the partition a row sits in, so a retried task or another
cluster size would draw differently. Hashing the row's own key does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(value) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast("string")


def hash_key(*parts) -> Column:
    """The '|'-joined parts that a uniform number is drawn from."""
    return F.concat_ws("|", *[_part(p) for p in parts])


def _head(key: Column) -> Column:
    """The first 32 bits of the key's md5, as eight lower-case hex digits."""
    return F.substring(F.md5(key), 1, 8)


def seeded_uniform(*parts) -> Column:
    """u in [0, 1) from the first 32 bits of md5 over the '|'-joined parts.

    Strings and numbers are literals; pass columns as ``F.col``.
    """
    return F.conv(_head(hash_key(*parts)), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_exceeds(key: Column, p: float) -> Column:
    """``seeded_uniform > p`` for a joined key, decided on the hex digits.

    Equally long hex numbers sort as strings, so nothing is converted: for tests that
    run once per word.
    """
    cut = math.floor(p * 4294967296.0)
    if cut < 0:
        return F.lit(True)
    if cut >= 4294967296:
        return F.lit(False)
    return _head(key) > F.lit(f"{cut:08x}")
