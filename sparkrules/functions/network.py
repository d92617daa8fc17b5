"""IPv4 addresses and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^\s*(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\s*$"


def ip_number(address: Column) -> Column:
    """A dotted address as a bigint; what is no address counts as 0.0.0.0, null stays null."""
    parts = F.transform(F.split(F.trim(address), r"\."), lambda p: p.cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
    return F.when(address.rlike(IPV4), value).when(address.isNotNull(), F.lit(0).cast("bigint"))


def parse_ip(text: str) -> int:
    parts = text.strip().split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
        raise ValueError(f"not an IPv4 address: {text!r}")
    return sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts))


def cidr_range(text: str) -> tuple[int, int]:
    """First and last address; without a length it is a single address, and lengths are clamped to 0..32."""
    base, slash, length = text.strip().partition("/")
    bits = min(32, max(0, int(length))) if slash else 32
    size = 1 << (32 - bits)
    first = parse_ip(base) & ~(size - 1)
    return first, first + size - 1


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges that cover the same addresses."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out
