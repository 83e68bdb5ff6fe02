"""Address tests (EXP-05) and endpoint keys (JOIN-07, FIL-13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes counted as internal in compatible mode (only .16 and .31 of the 172 range).
INTERNAL_PREFIXES = ["10.", "192.168.", "127.", "172.16.", "172.31."]
# RFC 1918 plus loopback.
INTERNAL_STRICT = r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes])


def is_internal(ip: Column, strict: bool = False) -> Column:
    """EXP-05."""
    return ip.rlike(INTERNAL_STRICT) if strict else starts_with_any(ip, INTERNAL_PREFIXES)


def endpoint(ip: Column, port: Column) -> Column:
    return F.struct(ip.alias("ip"), port.cast("int").alias("port"))


def conversation_key(protocol: Column, src: Column, dst: Column) -> Column:
    """JOIN-07: one key for both directions, so no join between packets and flows is needed."""
    return F.struct(protocol.alias("protocol"), F.least(src, dst).alias("low"), F.greatest(src, dst).alias("high"))
