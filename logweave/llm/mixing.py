"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words. Its documents' expected copies are target / size of the source; their
prefix sums within the source, shifted by one random offset, emit a document once for each integer that
they cross. The documents of a source are ordered by falling size, which makes the sample stratified by
size, so what a source gives differs from its target by about its largest document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.frames import few_bytes, materialise, row_hash
from logweave.llm.splitters import RANGES, plan_ranges, with_prefix

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = "mix-1"
#: The table of sources is broadcast only while it has at most this many rows.
SOURCES_BROADCAST = 10_000


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    gaps = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(gaps == "", F.lit(0)).otherwise(F.length(gaps) - F.length(F.replace(gaps, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Targets for a table (source, source_size, source_rows).

    Sources in code-point order, null last, take the weights in turn and share all words. A target stops
    at max_copies times its source; what is left over goes to the others by weight until none is above.
    That is the level L at which the sum of min(cap, L * weight) is the total: with the sources sorted by
    cap / weight, one prefix sum finds it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("full_at", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    held = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("first_rank", F.coalesce(F.sum("source_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight", F.get(held, F.pmod(F.col("place"), F.lit(len(weights)))))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    every = Window.partitionBy(F.lit(0))
    levelled = (
        ranked.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.min(F.when(F.col("left") / F.col("open_weight") <= F.col("full_at"), F.struct("full_at", "place", (F.col("left") / F.col("open_weight")).alias("v")))).over(every)["v"])
    )
    return levelled.select(
        "source", "source_size", "place", "first_rank",
        F.least("cap", F.col("level") * F.col("weight")).alias("target"),
    )


def _placed(sized: DataFrame, weights: tuple[float, ...], max_copies: int, seed: str, ranges: int) -> DataFrame:
    """``sized`` (stored; with __doc_id, __source, __size, __hash and __row) and source_size, target and copies."""
    sizes = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = materialise(source_targets(sizes, weights, max_copies), "mix-targets")
    few = targets.limit(SOURCES_BROADCAST + 1).count() <= SOURCES_BROADCAST and few_bytes(targets)
    ranked = targets.select(F.col("source").alias("__of"), "source_size", "target", F.col("first_rank").alias("__first"), F.col("place").cast("long").alias("__place"))
    joined = sized.join(F.broadcast(ranked) if few else ranked, sized["__source"].eqNullSafe(ranked["__of"])).drop("__of")
    joined = joined.withColumn("__falling", -F.col("__size")).withColumn("__id", F.coalesce(F.col("__doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("__one", F.lit(1).cast("long"))
    keys = ["__place", "__falling", "__id", "__hash", "__row"]
    ranked = with_prefix(joined, keys, "__one", plan_ranges(joined.select(*keys, "__one"), keys, "__one", ranges))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at, start = F.col("__rank") - F.col("__first"), offset(F.col("__source"), seed)
    return ranked.withColumn("copies", F.floor((at + 1) * rate + start) - F.floor(at * rate + start)).drop("__before", "__rank", *[k for k in keys if k != "__row"], "__one", "__first")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, hashed: Column) -> list[Column]:
    return [F.col(id_col).alias("__doc_id"), F.col(source_col).alias("__source"), count_words(F.col(text_col)).alias("__size"), hashed.alias("__hash"), F.monotonically_increasing_id().alias("__row")]


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ranges: int = RANGES) -> DataFrame:
    """One row for each row of docs: id, size, source, source_size, target, copies, taken.

    size counts words, copies is how often the mix holds the document, taken is size * copies. A null text
    has size 0; null sources form one source, placed last; null ids sort first; the order among rows of equal
    source, size and id does not change the rows; an empty table gives no rows. A source without words has
    target 0 and no copies. Results depend on the rows alone, so reruns agree.
    """
    sized = materialise(docs.select(*_sized(docs, id_col, text_col, source_col, F.lit(0).cast("long"))), "mix-sizes")
    placed = _placed(sized, weights, max_copies, seed, ranges)
    return placed.select(F.col("__doc_id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source").alias("source"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"))


def mix_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ranges: int = RANGES) -> DataFrame:
    """The mixed corpus: every row of docs as often as the mix takes it, with all columns of docs.

    Rows are ordered as in ``mix_sources`` and, where source, size and id are equal, by a hash of all columns. A row
    travels through the ranges with its columns, so no join has to find it again.
    """
    names = docs.columns
    held = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__held")
    sized = materialise(docs.select(held, *_sized(docs, id_col, text_col, source_col, row_hash(docs, names))), "mix-rows")
    placed = _placed(sized, weights, max_copies, seed, ranges).where("copies > 0")
    return placed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__held.*")


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source in [0, 1): 32 bits of a digest of seed and name."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
