"""Events from files, tables and streams, and events written per output anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """events(message, source) of text files, one for each line."""
    return spark.read.text(path).select(F.col("value").alias("message"), F.col("_metadata.file_path").alias("source"))


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """events(message): one JSON document a line, kept as text for the parser."""
    return spark.read.text(path).select(F.col("value").alias("message"))


def table_events(spark: SparkSession, name: str, message: str) -> DataFrame:
    """events of a catalog table, with the column that holds the line."""
    return spark.table(name).withColumn("message", F.col(message))


def kafka_stream(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """A stream of events(message, timestamp); the Kafka connector must be on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    return reader.options(**options).load().select(F.col("value").cast("string").alias("message"), "timestamp")


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """A stream over a folder of Parquet files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def jdbc_lookup(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A snapshot of a lookup table (key, value) over JDBC."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def write_by_anchor(routed: DataFrame, path: str) -> None:
    """Parquet partitioned by output anchor; an event goes to each of its anchors."""
    routed.withColumn("anchor", F.explode("_output")).drop("_output").write.partitionBy("anchor").parquet(path)
