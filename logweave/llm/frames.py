"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set of ids or digests is broadcast only while it has at most this many rows (8 or 16 bytes each).
BROADCAST_ROWS = 1_000_000
#: A table with texts in it is broadcast only while its columns have at most this many bytes.
BROADCAST_BYTES = 32_000_000
#: Rows whose texts a worker holds as Python objects at a time.
SLICE = 512
#: Folders written by this session and not yet deleted.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share.

    ``spark.checkpoint.dir`` is the cluster's choice and Spark applies it to the context by itself.
    Only where nothing is set (as in tests) a folder below the warehouse is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_exit, spark)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``discard``: how many intermediate folders there are."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the intermediate folders written after the mark ``since``, except the last ``but``. For callers that have
    stored what they read from them."""
    gone = _written[since : len(_written) - but]
    jvm = spark._jvm
    for path in gone:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        discard(spark)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small frames of iterative steps."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of the frame has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def filter_rows(docs: DataFrame, columns: list[str], start: Callable[[], Callable[[list[tuple]], list[bool]]]) -> DataFrame:
    """The rows of docs, with all columns, for which a decision made in Python is true: the verdict is made beside
    the row, so no join has to find it again.

    start() runs once in each task and gives the function from rows of ``columns`` (texts as UTF-8 bytes, null as it
    is) to decisions.
    """
    names = docs.columns
    at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = start()
        for batch in batches:
            held = [b.cast(pa.binary()) if pa.types.is_string(b.type) else b for b in (batch.column(i) for i in at)]
            keep: list[bool] = []
            for k in range(0, batch.num_rows, SLICE):
                keep += decide(list(zip(*(h.slice(k, SLICE).to_pylist() for h in held), strict=True)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def few_bytes(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table may be broadcast, by the measured bytes of its rows."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema]
    total = df.agg(F.sum(sum(sizes, F.lit(16)))).first()[0] or 0
    return total <= limit


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """64 bits of a hash over columns of any type: settles the order of rows whose ids are equal or null."""
    maps = {f.name for f in df.schema if "map<" in f.dataType.simpleString()}
    return F.xxhash64(*[F.to_json(F.struct(df[c])) if c in maps else df[c] for c in columns])


def digest60(text: Column) -> Column:
    """60 bits of MD5 as a long: a key that other SQL engines can compute, too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def without_ids(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is not among ids; rows with a null key stay.

    The ids are broadcast only if their count is at most ``limit``; else both sides are shuffled.
    """
    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")
