"""Bounded samples on which models are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many times the wanted rows are let through the first cut, so that fewer than wanted are next to impossible.
SPARE = 3


def first_by_hash(rows: DataFrame, key: str, most: int, seed: int = 0) -> list:
    """At most ``most`` rows, those with the smallest hashes of ``key``; always the same ones, whatever the partitions.

    A count, which Parquet answers from its footers, sets a threshold of the hash under which about SPARE times as
    many rows fall, so that every task sends a few rows to the driver and all together a bounded number."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    n = rows.select(key).count()
    if not n:
        return []
    under = min(1 << 40, int((1 << 40) * SPARE * (most + 100) / n) + 1)
    return rows.where(h < under).orderBy(h, key).limit(most).collect()


def first_of_each(rows: DataFrame, key: str, group: str, most: int, seed: int = 0) -> list[tuple]:
    """(key, group) of at most ``most`` rows of each group, those with the smallest hashes of ``key``; a null group is one too.

    The groups must be few: their sizes come to the driver, which sets each one's threshold as ``first_by_hash`` does."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    sizes = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}
    under = F.lit(0)
    for g, n in sizes.items():
        under = F.when(F.col(group).eqNullSafe(F.lit(g)), min(1 << 40, int((1 << 40) * SPARE * (most + 100) / n) + 1)).otherwise(under)
    found: dict = {}
    for r in sorted(rows.where(h < under).select(key, group, h.alias("_h")).distinct().collect(), key=lambda r: (r[2], r[0])):
        found.setdefault(r[1], []).append((r[0], r[1]))
    return [x for xs in found.values() for x in xs[:most]]
