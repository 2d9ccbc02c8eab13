"""A seeded hash that any SQL engine with md5 can reproduce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hex digits, so a value always fits a signed 64-bit integer.
HASH_SPACE = float(16**15)


def stable_hash(*parts: Column | str) -> Column:
    """Uniform integer in [0, 16**15) from the parts joined by '|'."""
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
