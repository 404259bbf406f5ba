"""Sharding by sampled splitters [DataFrame functions only].

Rows are ordered by a digest of their text, then by id. Size-weighted samples give quantile boundaries,
the rows are range-partitioned at them, overfull ranges are subdivided, and exact prefix sums over the
ranges place every row: the shards are consecutive stretches of the order with near-equal bytes. Equal
texts stand together and are split only where a stretch ends, so a text that makes up a third of all
rows spreads over as many shards as its bytes need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.frames import digest60, materialise, utf8
from logweave.llm.splitters import RANGES, plan_ranges, with_prefix

SHARDS = 8


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot and grown_shard.

    size is the UTF-8 length plus 1. A row goes to the shard in which the middle of its stretch of bytes
    falls, so shards differ by less than the largest row. slot numbers the rows of a shard from 0 in the
    order. A null text counts as an empty one; null ids sort first; equal rows take consecutive slots; an
    empty table gives no rows. Other columns of docs are not read.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(utf8(text)) + 1).cast("long").alias("size"),
        F.crc32(utf8(text)).alias("text_crc32"),
        digest60(utf8(text)).alias("__digest"),
        F.monotonically_increasing_id().alias("__row"),  # lets a range end between rows that are equal otherwise
    ).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    slim = materialise(slim, "shard-keys")
    keys = ["__digest", "__id", "__row"]
    plan = plan_ranges(slim, keys, "size", max(ranges, 4 * shards))
    total = max(1, sum(plan.weights))
    middle = 2 * F.col("__before") + F.col("size")
    placed = with_prefix(slim, keys, "size", plan).select(
        "doc_id", "size", "text_crc32", F.col("__rank").alias("rank"),
        F.least(F.floor(middle * shards / F.lit(2 * total)), F.lit(shards - 1)).cast("int").alias("shard"),
    )
    placed = materialise(placed, "shard-places")
    counts = dict(placed.groupBy("shard").count().collect())  # one row for each shard
    first, seen = [], 0
    for k in range(shards):
        first.append(F.lit(seen).cast("long"))
        seen += counts.get(k, 0)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.get(F.array(*first), F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
