"""Joins that enrich events from reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A reference table is broadcast only while it has at most this many rows and its values this many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000
#: Address ranges are cut at blocks of this many addresses, which are the keys of the range join.
BLOCK = 1 << 16


def _small(table: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in table.schema]
    rows, size = table.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(sizes, F.lit(0))), F.lit(0))).first()
    return rows <= limit and size <= BROADCAST_BYTES


def lookup_join(events: DataFrame, table: DataFrame, key: str, out: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A left join on ``key``; table: (key, value), one value is taken for each key. The table is broadcast if
    it is small, else both sides are shuffled (adaptive execution splits hot keys)."""
    held = table.select(F.col("key").cast("string").alias("__lookup_key"), F.col("value").alias(out)).dropDuplicates(["__lookup_key"])
    side = F.broadcast(held) if _small(table, limit) else held
    return events.join(side, F.col(f"`{key}`") == F.col("__lookup_key"), "left").drop("__lookup_key")


def range_lookup(events: DataFrame, ranges: DataFrame, number: str, columns: dict[str, str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """A left join of ``number`` with ranges (low, high, ...), which must not overlap.

    Ranges are cut at block bounds, so the join is an equi join on the block and a comparison: no nested loop.
    """
    blocks = ranges.withColumn("__block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))))
    blocks = blocks.select("__block", F.col("low").alias("__low"), F.col("high").alias("__high"), *[F.col(c).alias(a) for c, a in columns.items()])
    side = F.broadcast(blocks) if _small(blocks, limit) else blocks
    value = F.col(f"`{number}`")
    on = (F.floor(value / BLOCK) == F.col("__block")) & value.between(F.col("__low"), F.col("__high"))
    return events.join(side, on, "left").drop("__block", "__low", "__high")
