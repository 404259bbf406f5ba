"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance d <= 3 have a common variant within half of that from either. Each
distinct fingerprint emits such variants, the variants are shuffled, and fingerprints that collide on one
are linked. Rounding 3 / 2 up for everybody would take 2,081 variants each. Two facts cut that to 64 or
1,057. Fingerprints at distance 1 or 3 differ in parity, so only those with an odd number of ones go two
bits far. And of three differing bits two lie in the same half, so only pairs within a half are flipped.

A colliding group needs no pairs: its members are one bit ("near") or two bits ("far") from the variant.
If any member is near, each other member is within three bits of it, and the group is linked as a star
around it; if none is, nothing follows from this variant, and pairs at distance 2 meet at another one.
Distinct fingerprints around one variant number 1,122 at most, so no key can run hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logweave.llm.components import connected_components
from logweave.llm.frames import BROADCAST_ROWS, SLICE, materialise, own_name, row_hash, utf8

WORDS = 3
SEED = 42
RADIUS = 3
#: Variants in one bucket, 10 bytes each: bounds the memory of a task that searches a bucket.
BUCKET = 600_000
#: Fingerprints expanded together.
CHUNK = 1024

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ONE = np.uint64(1)
_SINGLES = [1 << i for i in range(64)]
_PAIRS = [(1 << i) | (1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
#: Bits that a variant flips; the first 65 keep it near.
MASKS = np.array([0, *_SINGLES, *_PAIRS], dtype=np.uint64)
NEAR = 65
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes) -> int:
    """SimHash of the lower-cased words' shingles: a bit is set if more than half of the hashes have it."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    counts, total, step = np.zeros(64, dtype=np.int64), 0, 1 << 16
    for at in range(0, max(1, len(words) - WORDS + 1), step):
        part = words[at : at + step + WORDS - 1]
        if len(part) < WORDS:
            shingles = [b" ".join(part)]
        else:
            shingles = list(map(b" ".join, zip(*(part[k:] for k in range(WORDS)), strict=False)))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles))
        counts += _bit_counts(hashes)
        total += len(hashes)
    return int((_ONE << np.flatnonzero(counts * 2 > total).astype(np.uint64)).sum(dtype=np.uint64))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit: eight byte lanes at a time, flushed before they overflow."""
    out = np.empty((8, 8), dtype=np.int64)  # [shift, lane]
    lanes = np.uint64(0x0101010101010101)
    cuts = np.arange(0, len(hashes), 255)
    for s in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(s)) & lanes, cuts)
        out[s] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.T.reshape(64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1)
        prints = np.array([fingerprint(t) for k in range(0, b.num_rows, SLICE) for t in texts.slice(k, SLICE).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null and blank texts have fingerprint 0."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("t"))
    return slim.mapInArrow(_fingerprints, "doc_id long, fp long")


def _variants(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), CHUNK):
                prints = every[at : at + CHUNK]
                odd = (np.bitwise_count(prints) & 1).astype(bool)
                flips = np.concatenate([np.tile(np.arange(1, NEAR, dtype=np.uint16), (~odd).sum()), np.tile(np.arange(len(MASKS), dtype=np.uint16), odd.sum())])
                own = np.concatenate([np.repeat(prints[~odd], NEAR - 1), np.repeat(prints[odd], len(MASKS))]) ^ MASKS[flips]
                bucket = (((own * _MIX) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32 if buckets > 65536 else np.uint16)
                order = np.argsort(bucket, kind="stable")
                own, flips, bucket = own[order], flips[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + 1 if len(bucket) else 0))
                ends = np.append(cuts[1:], len(bucket))
                payload = [own[i:j].tobytes() + flips[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(payload, pa.binary())], ["bucket", "variants"])

    return run


def _links(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, near member of its group) among the variants of one bucket, each once."""
    own = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 10) for p in parts])
    flips = np.concatenate([np.frombuffer(p, np.uint16, len(p) // 10, len(p) // 10 * 8) for p in parts])
    order = np.argsort(own)
    own = own[order]
    same = own[1:] == own[:-1]
    grouped = np.concatenate([same, [False]]) | np.concatenate([[False], same])  # groups of one have no link
    own, flips = own[grouped], flips[order[grouped]]
    if not len(own):
        return own, own
    group = np.cumsum(np.concatenate([[0], (own[1:] != own[:-1]).astype(np.int64)]))
    prints = own ^ MASKS[flips]
    near = flips < NEAR
    centre = np.zeros(group[-1] + 1, dtype=np.uint64)
    has = np.zeros(group[-1] + 1, dtype=bool)
    centre[group[near]] = prints[near]
    has[group[near]] = True
    keep = has[group] & (prints != centre[group])
    a, b = prints[keep], centre[group[keep]]
    links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    links = links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= RADIUS]
    return links[:, 0], links[:, 1]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket is held at a time."""

    def out(parts: list[bytes]) -> pa.RecordBatch:
        a, b = _links(parts)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held, parts = None, []
    for batch in batches:
        for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != held and parts:
                yield out(parts)
                parts = []
            held = k
            parts.append(p)
    if parts:
        yield out(parts)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links that connect all fingerprints within RADIUS bits of each other; prints: distinct longs ``fp``."""
    per_print = (64 + len(MASKS)) // 2
    buckets = max(64, -(-prints.count() * per_print // BUCKET))
    spread = prints.select("fp").mapInArrow(_variants(buckets), "bucket int, variants binary")
    return spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the smallest id that links of RADIUS bits or fewer reach, the own id included. Texts
    that are null or blank share fingerprint 0, which is linked like any other. Rows of equal text share a
    fingerprint and are one node. A null id keeps its row and is ignored in minima (the component of rows
    that all have null ids is null); rows with equal ids are separate rows. An empty table gives no rows.
    """
    prints = materialise(simhashes(docs, id_col, text_col), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(fingerprint_links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.where("root <> fp").groupBy("root").agg(F.min("least").alias("least")).withColumnRenamed("root", "r").withColumnRenamed("least", "l")
    named = placed.join(least, placed["root"] == least["r"], "left")
    # The root itself is one of the component's members, and its own smallest id counts as well.
    own = placed.where("root = fp").select(F.col("fp").alias("of"), F.col("least").alias("of_least"))
    named = named.join(own, named["root"] == own["of"], "left").select("fp", F.least("least", "l", "of_least").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose component has an earlier row: one row of each group stays.

    Rows are ordered by id, null last, then by a hash of all columns; of equal rows any one stays. Rows are stored with
    their fingerprints and numbered there, so ids may be null or repeated.
    """
    names = docs.columns
    fp, row = own_name(docs, "fp"), own_name(docs, "row")
    at = names.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, prints = b.column(at).cast(pa.binary()), []
            for k in range(0, b.num_rows, SLICE):
                prints += [fingerprint(t or b"") for t in texts.slice(k, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], [*names, fp])

    tagged = docs.mapInArrow(add, _with_long(docs, fp))
    tagged = materialise(tagged.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), row_hash(tagged, names).alias("hash"), F.col(row).alias("row"))
    nodes = materialise(tagged.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")), "simhash-distinct")
    roots = connected_components(fingerprint_links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    first = placed.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stays = materialise(first.select(F.col("first.row").alias(row)), "simhash-first")
    few = stays.count() <= BROADCAST_ROWS
    return tagged.join(F.broadcast(stays) if few else stays, row, "left_semi").select(*names)


def _with_long(df: DataFrame, name: str) -> StructType:
    return StructType([*df.schema.fields, StructField(name, LongType())])
