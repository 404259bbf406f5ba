"""Splitting an ordered frame into ranges of near-equal weight, and exact prefix sums over it.

A window function over one unpartitioned order would send every row to one task. Here the order is cut
at sampled splitters first, so each range is a group of bounded weight; the ranges' totals (one row for
each range, a number that is a parameter) give every range its exact offset.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into at least and at most, rows of one above the least number, and samples
#: drawn for each range; together they bound what reaches the driver (200,000 keys).
RANGES, MAX_RANGES = 512, 8192
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 24
#: A range with more than this many times its share is subdivided.
OVERFULL = 2.0
ROUNDS = 4


def _draw(df: DataFrame, keys: list[str], weight: str, step: float, seed: int) -> DataFrame:
    """Keys drawn with a probability in proportion to their weight, one for each ``step`` of weight on
    average; a row of ``step`` or more is always drawn. Each draw stands for the weight ``mass``."""
    chance = F.col(weight) / F.lit(step)
    coin = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(coin < chance).select(*keys, F.greatest(F.col(weight).cast("double"), F.lit(step)).alias("mass"))


def _cuts(drawn: list[tuple], parts: int) -> list[tuple]:
    """Quantile boundaries of weighted draws: at most parts - 1 keys, each the first of its range."""
    drawn.sort()
    total = sum(m for *_, m in drawn)
    out: list[tuple] = []
    seen, due = 0.0, 1
    for *key, mass in drawn:
        if seen * parts >= total * due:
            if not out or tuple(key) > out[-1]:
                out.append(tuple(key))
            due = int(seen * parts / total) + 1
        seen += mass
    return out


def range_of(keys: list[str], cuts: list[tuple]) -> Column:
    """The number of cuts at or below the row's key: a binary search over a literal array."""
    if not cuts:
        return F.lit(0)
    row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    held = F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'k{i}', bigint('{v}')" for i, v in enumerate(c)) + ")" for c in cuts) + ")")
    n, steps = len(cuts), []
    step = 1 << (n.bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= F.lit(n)) & (F.get(held, at + s - 1) <= row), at + s).otherwise(at),
    )


@dataclass
class Ranges:
    cuts: list[tuple]
    weights: list[int]
    rows: list[int]


def plan_ranges(df: DataFrame, keys: list[str], weight: str, ranges: int = RANGES, seed: int = 7) -> Ranges:
    """Choose the cuts for near-equal weight and measure every range exactly.

    keys are non-null longs that order the rows; weight is a non-negative number. Ranges that come out
    overfull are sampled again and subdivided, for as long as a round still splits one.
    """
    total, count = df.agg(F.sum(weight), F.count(F.lit(1))).first()
    total, ranges = total or 0, max(ranges, min(MAX_RANGES, count // ROWS_PER_RANGE))
    cuts: list[tuple] = []
    if total:
        step = float(total) / (ranges * SAMPLES_PER_RANGE)
        cuts = _cuts([tuple(r) for r in _draw(df, keys, weight, step, seed).collect()], ranges)
    for turn in range(ROUNDS):
        placed = df.withColumn("__range", range_of(keys, cuts))
        sizes = {r[0]: (int(r[1] or 0), r[2]) for r in placed.groupBy("__range").agg(F.sum(weight), F.count(F.lit(1))).collect()}
        over = [k for k, (w, n) in sizes.items() if n > 1 and w > OVERFULL * total / ranges]
        if not over or turn == ROUNDS - 1:
            break
        step = float(total) / (ranges * SAMPLES_PER_RANGE)
        again = _draw(placed.where(F.col("__range").isin(over)), ["__range", *keys], weight, step, seed + 1 + turn).collect()
        more = set(cuts)
        for k in over:
            own = [tuple(r)[1:] for r in again if r[0] == k]
            more.update(_cuts(own, max(2, round(sizes[k][0] * ranges / total))))
        if len(more) == len(cuts):
            break
        cuts = sorted(more)
    n = len(cuts) + 1
    return Ranges(cuts, [sizes.get(k, (0, 0))[0] for k in range(n)], [sizes.get(k, (0, 0))[1] for k in range(n)])


def with_prefix(df: DataFrame, keys: list[str], weight: str, plan: Ranges) -> DataFrame:
    """Add ``__before`` (weight of all rows ordered before this one) and ``__rank`` (their number), exactly."""

    def offsets(sizes: list[int]) -> Column:
        starts = [0, *accumulate(sizes)][:-1]
        return F.get(F.expr("array(" + ", ".join(f"bigint('{s}')" for s in starts) + ")"), F.col("__range"))

    own = Window.partitionBy("__range").orderBy(*keys)
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("__range", range_of(keys, plan.cuts))
        .withColumn("__before", offsets(plan.weights) + F.sum(weight).over(running) - F.col(weight))
        .withColumn("__rank", offsets(plan.rows) + F.row_number().over(own) - 1)
        .drop("__range")
    )


def find_range(key: tuple, cuts: list[tuple]) -> int:
    """What range_of computes, for one key on the driver."""
    return bisect_right(cuts, key)
