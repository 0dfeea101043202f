"""Deterministic randomness from md5 of a ``|``-joined key.

Every random decision of the search (initial bits, partition, shuffle
order, crossover coin, mutation draw, hold-out split) is a pure function of
``(seed, generation, id, position, ...)``.  Results therefore do not depend
on partitioning, task retries or executor loss, and the same expressions
are available in plain SQL engines (md5, substr, hex parsing).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_POW_32 = 4294967296.0


def _as_col(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def hash_key(*parts) -> Column:
    """md5 hex digest of ``p1|p2|...`` (literals or columns)."""
    return F.md5(F.concat_ws("|", *[_as_col(p) for p in parts]))


def coin(*parts) -> Column:
    """Fair bit: 1 when the first hex digit of the key's md5 is 8..f."""
    return F.when(F.substring(hash_key(*parts), 1, 1) >= F.lit("8"), F.lit(1)).otherwise(F.lit(0))


def hex_prefix_int(digest: Column, n_digits: int = 8) -> Column:
    """Unsigned integer value of the first ``n_digits`` hex digits."""
    return F.conv(F.substring(digest, 1, n_digits), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Draw in [0, 1) with 2**-32 resolution."""
    return hex_prefix_int(hash_key(*parts)) / F.lit(_TWO_POW_32)


def bucket(n: int, *parts) -> Column:
    """Integer in [0, n) taken from the key's md5 (never negative)."""
    return F.pmod(hex_prefix_int(hash_key(*parts)), F.lit(int(n))).cast("int")
