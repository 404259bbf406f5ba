"""A cleaning pipeline over documents: quality rules, near duplicates, benchmark leaks, mixing, sharding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame, which is written
as Parquet and read again as the next stage's docs. ``run`` chains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontaminate, mixing, quality, sharding, simhash
from logweave.llm.frames import discard, materialise, table, written
from logweave.llm.queries import quality_vocabularies

#: The first stage scores texts with a tokeniser, which SQL cannot express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, quality_vocabularies())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark item's window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the training shards."""
    return sharding.shard_by_bytes(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", benchmark_leaks), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
            discard(spark, mark, but=1)  # all but the stage's own result
    return docs
