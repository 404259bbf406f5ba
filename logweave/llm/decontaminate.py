"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

An item's window is ten consecutive words of it (all words of a shorter item). For exact containment of a
window, a document stretch must hold every shingle of it, so joining on a single one is enough: the rarest,
by counts over the whole corpus. A match at shingle position p fixes the stretch: it begins p minus the
shingle's place in the window, and must lie inside the document (the length and positional bounds). Only
then are the words compared.

Documents are searched as flat byte and word arrays. Hashes of words only choose candidates; each hit's
bytes are compared with the item's words. Where all items' texts are small by measure, their index goes to
every task and the documents are searched in place. Any larger benchmark is joined by shuffling: documents
emit the places whose shingle passes a bit table of fixed size, with the words around them, and these meet
the windows on their anchors. Both ways read the documents twice, whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.bits import bit_table, passing
from logweave.llm.frames import filter_rows, materialise, own_name, utf8, without_ids

WINDOW = 10
SHINGLE = 3
#: Bytes of item text up to which its index goes to every task; it takes about 30 times as much memory.
BLOCK_BYTES = 2_000_000
#: Bits (as a power of two) of the tables that documents' shingles must pass before they are shuffled.
LOG_BITS = 26
#: Bytes of document text that are tokenised together.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words after lower-casing: digits, a-z and all of UTF-8's multi-byte sequences.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class _Hasher:
    """Hashes all words of a byte array at once, by differences of a polynomial's prefix sums."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1), _powers(_BACK, 1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.up):
            n = 1 << (len(data) + 1).bit_length()
            self.up, self.down = _powers(_BASE, n), _powers(_BACK, n)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        own = (sums[ends] - sums[starts]) * self.down[starts]
        own ^= own >> np.uint64(29)
        return own * _MIX[0] + (ends - starts).astype(np.uint64)


@dataclass
class Words:
    """Texts as arrays: lower-cased bytes, each word's hash, start and end, and each text's first word."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # length: texts + 1

    def window(self, at: int, n: int) -> tuple[bytes, ...]:
        return tuple(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + n))


def tokenise(texts: list[bytes], hasher: _Hasher) -> Words:
    """A zero byte after each text ends its last word; words never reach over it."""
    data = LOWER[np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)]
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    inside = np.concatenate([[False], WORD_BYTE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # byte-level arrays are 8 times as large as the text, so they are made in parts
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right")))
        low = starts[at]
        hashes[at:to] = hasher.words(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low)
        at = to
    return Words(data, hashes, starts, ends, np.searchsorted(starts, bounds))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    out = hashes[: max(0, len(hashes) - n + 1)] * _MIX[1]
    for k in range(1, n):
        out = out + hashes[k : len(hashes) - n + 1 + k] * _MIX[1 + k]
    return out


@dataclass
class Lookup:
    """From a 64-bit key to rows: a bit table that most keys fail, then a binary search."""

    keys: np.ndarray
    first: np.ndarray
    bits: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, keys: np.ndarray) -> tuple[Lookup, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        held, first = np.unique(keys[order], return_index=True)
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(held >> np.uint64(44)).astype(np.int64)] = True
        return cls(held, np.append(first, len(keys)), bits), order

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in keys that are held, and the number of the held key."""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(keys >> np.uint64(44)).astype(np.int64)])
        to = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        ok = self.keys[to] == keys[at]
        return at[ok], to[ok]


@dataclass
class Index:
    """Windows of one block of items. Each is anchored at one of its shingles; kinds: by shingle length."""

    items: list[str]
    texts: list[tuple[bytes, ...]]  # the words of each window
    length: np.ndarray
    place: np.ndarray  # of the anchor in the window
    owners: list[list[int]]  # items that have the window
    kinds: dict[int, tuple[Lookup, np.ndarray]]


def distinct_windows(items: list[tuple[str, bytes]], window: int, hasher: _Hasher) -> dict[tuple[bytes, ...], list[int]]:
    found: dict[tuple[bytes, ...], list[int]] = {}
    for k, (_, text) in enumerate(items):
        words = tokenise([text], hasher)
        n = len(words.hashes)
        for at in range(max(1, n - window + 1) if n else 0):
            owners = found.setdefault(words.window(at, min(n, window)), [])
            if not owners or owners[-1] != k:
                owners.append(k)
    return found


def _window_shingles(text: tuple[bytes, ...], hasher: _Hasher) -> np.ndarray:
    own = tokenise([b" ".join(text)], hasher).hashes
    return shingles(own, min(SHINGLE, len(own)))


def build_index(items: list[tuple[str, bytes]], window: int, counts: dict[int, int], hasher: _Hasher) -> Index:
    found = distinct_windows(items, window, hasher)
    texts = list(found)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    place, keys = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint64)
    for k, t in enumerate(texts):
        own = _window_shingles(t, hasher)
        at = min(range(len(own)), key=lambda i: (counts.get(int(own[i]), 0), int(own[i])))
        place[k], keys[k] = at, own[at]
    kinds = {}
    for n in range(1, SHINGLE + 1):
        if len(own := np.flatnonzero(np.minimum(length, SHINGLE) == n)):
            lookup, order = Lookup.of(keys[own])
            kinds[n] = (lookup, own[order])
    return Index([i for i, _ in items], texts, length, place, list(found.values()), kinds)


def search(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every occurrence of a window in the texts."""
    at_all, win_all = [], []
    checked: dict[tuple[int, bytes], bool] = {}
    text_of = np.searchsorted(words.firsts, np.arange(len(words.hashes)), side="right") - 1
    for n, (lookup, rows) in index.kinds.items():
        at, key = lookup.find(shingles(words.hashes, n))
        if not len(at):
            continue
        many = lookup.first[key + 1] - lookup.first[key]  # windows that are anchored at this shingle
        at, low = np.repeat(at, many), np.repeat(lookup.first[key], many)
        win = rows[low + np.arange(len(low)) - np.repeat(np.cumsum(many) - many, many)]
        begin = at - index.place[win]
        end = begin + index.length[win]
        text = text_of[at]
        ok = (begin >= words.firsts[text]) & (end <= words.firsts[text + 1])
        for b, e, w in zip(begin[ok].tolist(), end[ok].tolist(), win[ok].tolist(), strict=True):
            raw = words.data[words.starts[b] : words.ends[e - 1]].tobytes()
            same = checked.get((w, raw))
            if same is None:
                same = checked[w, raw] = words.window(b, e - b) == index.texts[w]
            if same:
                at_all.append(b)
                win_all.append(w)
    return np.array(at_all, np.int64), np.array(win_all, np.int64)


def _grouped(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about CHUNK_BYTES."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


def _matcher(shared):
    """Adds what one block finds to the columns runs (pairs of first word and end) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hasher = pickle.loads(shared.value), _Hasher()
        for batch in batches:
            names = batch.schema.names
            texts = batch.column("t").to_pylist()
            runs, items, counts = batch.column("runs").to_pylist(), batch.column("items").to_pylist(), np.zeros(len(texts), np.int64)
            for first, group in _grouped(texts):
                words = tokenise(group, hasher)
                counts[first : first + len(group)] = np.diff(words.firsts)
                at, win = search(words, index)
                order = np.argsort(at, kind="stable")
                text = np.searchsorted(words.firsts, at, side="right") - 1
                for i in order.tolist():
                    k = first + int(text[i])
                    b = int(at[i] - words.firsts[text[i]])
                    e = b + int(index.length[win[i]])
                    if runs[k] and runs[k][-2] <= b <= runs[k][-1]:
                        runs[k][-1] = max(runs[k][-1], e)
                    else:
                        runs[k] = [*runs[k], b, e] if not runs[k] else runs[k].__iadd__([b, e])
                    items[k].extend(index.items[o] for o in index.owners[win[i]])
            items = [sorted(set(x)) for x in items]
            new = {"runs": pa.array(runs, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(counts)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return run


def _counter(shared):
    """Occurrences of the block's shingles in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, hasher = pickle.loads(shared.value), _Hasher()
        totals = {n: np.zeros(len(look.keys), np.int64) for n, look in kinds.items()}
        for batch in batches:
            for _, group in _grouped(batch.column(0).to_pylist()):
                words = tokenise(group, hasher)
                for n, look in kinds.items():
                    totals[n] += np.bincount(look.find(shingles(words.hashes, n))[1], minlength=len(look.keys))
        for n, look in kinds.items():
            some = np.flatnonzero(totals[n])
            yield pa.RecordBatch.from_arrays([pa.array(look.keys[some].view(np.int64)), pa.array(totals[n][some])], ["shingle", "n"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of hit words from the runs, and the digest of the items."""
    for b in batches:
        hits = []
        for runs in b.column("runs").to_pylist():
            total, reach = 0, 0
            for s, e in sorted(zip(runs[::2], runs[1::2], strict=True)):
                total += max(0, e - max(s, reach))
                reach = max(reach, e)
            hits.append(total)
        items = b.column("items").to_pylist()
        columns = [b.column(0), b.column("n_words"), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), b.column("items")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items"])


def _windows(window: int):
    """(item, words, length, keys) of each distinct window of each item: its words, and its shingles' hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [b" ".join(w) for w in distinct_windows([(item, text)], window, hasher)]
                keys = [_window_shingles(tuple(w.split(b" ")), hasher).view(np.int64).tolist() for w in words]
                made = [pa.array([item] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()), pa.array([w.count(b" ") + 1 for w in words], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["item", "words", "length", "keys"])

    return run


def _all_counts(shared, log: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, hasher = np.frombuffer(shared.value, np.uint8), _Hasher()
        for batch in batches:
            for _, group in _grouped(batch.column(0).to_pylist()):
                hashes = tokenise(group, hasher).hashes
                every = [shingles(hashes, n) for n in range(1, SHINGLE + 1)]
                keys, n = np.unique(np.concatenate([k[passing(packed, k, log)] for k in every]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return run


def _candidates(shared, log: int, window: int):
    """For each document a row with its words' number, and one for each place whose shingle may be an anchor: the
    place, and the words around it that any window with this shingle can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, hasher = np.frombuffer(shared.value, np.uint8), _Hasher()
        for batch in batches:
            kind = batch.column("doc_id").type
            for first, group in _grouped(batch.column("t").to_pylist()):
                words, n = tokenise(group, hasher), len(group)
                sizes = np.diff(words.firsts)
                heads = [batch.column("row").slice(first, n), batch.column("doc_id").slice(first, n), pa.array(sizes), *[pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())]]
                names = ["row", "doc_id", "n_words", "key", "at", "low", "around"]
                yield pa.RecordBatch.from_arrays(heads, names)
                text_of = np.searchsorted(words.firsts, np.arange(len(words.hashes)), side="right") - 1
                for k in range(1, SHINGLE + 1):
                    keys = shingles(words.hashes, k)
                    at = passing(packed, keys, log)
                    for cut in range(0, len(at), 20_000):
                        part = at[cut : cut + 20_000]
                        own = text_of[part]
                        low = np.maximum(words.firsts[own], part - window + 1)
                        high = np.minimum(words.firsts[own + 1], part + window)
                        around = [b" ".join(words.window(i, j - i)).decode() for i, j in zip(low.tolist(), high.tolist(), strict=True)]
                        rows = batch.column("row").take(pa.array(first + own))
                        made = [rows, pa.nulls(len(part), kind), pa.array(sizes[own]), pa.array(keys[part].view(np.int64)), pa.array(part - words.firsts[own]), pa.array(part - low), pa.array(around, pa.string())]
                        yield pa.RecordBatch.from_arrays(made, names)

    return run


def _join_items(slim: DataFrame, items: DataFrame, window: int, log: int) -> DataFrame:
    """The search as a shuffled join on windows' anchors, for benchmarks of any size: two passes over the documents."""
    sc, kind = slim.sparkSession.sparkContext, slim.schema["doc_id"].dataType.simpleString()
    windows = materialise(items.mapInArrow(_windows(window), "item string, words string, length long, keys array<long>"), "item-windows")
    wanted = windows.select(F.explode("keys").alias("key")).distinct()
    counted = slim.select("t").mapInArrow(_all_counts(sc.broadcast(bit_table(wanted, log).tobytes()), log), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    placed = windows.select("item", "words", "length", F.posexplode("keys").alias("place", "key")).join(counted, "key", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place"))
    anchors = placed.groupBy("item", "words", "length").agg(rarest.alias("a")).select("item", "words", "length", "a.key", "a.place")
    anchors = materialise(anchors, "item-anchors")
    emit = _candidates(sc.broadcast(bit_table(anchors, log).tobytes()), log, window)
    numbered = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t")
    seen = materialise(numbered.mapInArrow(emit, f"row long, doc_id {kind}, n_words long, key long, at long, low long, around string"), "item-candidates")
    begin = F.col("at") - F.col("place")
    fits = (begin >= 0) & (begin + F.col("length") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), (F.col("low") - F.col("place") + 1).cast("int"), F.col("length").cast("int")), " ") == F.col("words")
    hits = seen.where("key is not null").join(anchors, "key").where(fits).where(same).select("row", "item", begin.alias("begin"), (begin + F.col("length")).alias("end"))
    hits = materialise(hits, "item-hits")
    before = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = hits.select("row", "begin", "end").distinct().select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    heads = seen.where("key is null").select("row", "doc_id", "n_words").join(n_hit.join(found, "row"), "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return heads.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), items_of.alias("items"))


def _named_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), utf8(F.col(text_col)).alias("t")).distinct()


def _small_index(texts: DataFrame, items: DataFrame, window: int, block_bytes: int) -> Index | None:
    """The index over all items, if their measured text is small enough to be sent to every task; else nothing."""
    if (items.agg(F.sum(F.octet_length("t") + F.octet_length("id"))).first()[0] or 0) > block_bytes:
        return None
    hasher, keys = _Hasher(), {}
    held = sorted((r["id"], bytes(r["t"])) for r in items.collect())
    for t in distinct_windows(held, window, hasher):
        keys.setdefault(min(SHINGLE, len(t)), set()).update(_window_shingles(t, hasher).tolist())
    kinds = {n: Lookup.of(np.array(sorted(ks), np.uint64))[0] for n, ks in keys.items()}
    counter = _counter(texts.sparkSession.sparkContext.broadcast(pickle.dumps(kinds)))
    counted = texts.mapInArrow(counter, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = {r["shingle"] % (1 << 64): r["n"] for r in counted.collect()}  # as many rows as the items have shingles, at most
    return build_index(held, window, counts, hasher)


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, log_bits: int = LOG_BITS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, items.

    n_hit counts the words inside any occurrence of a window, items lists the ids (as sorted strings) of
    the items with an occurring window. Null and empty texts have no words and hit nothing; items without
    words have no window; an item id that is null is named by the empty string; rows of one item id count
    as one item; equal documents are found alike. Empty tables give no rows, or no hits. Items of up to
    block_bytes of text are searched in place, larger benchmarks by a shuffled join, with the same rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("t"))
    named = _named_items(items, item_col, item_text)
    index = _small_index(slim.select("t"), named, window, block_bytes)
    if index is None:
        return _join_items(slim, named, window, log_bits)
    found = slim.select("doc_id", "t", F.array().cast("array<long>").alias("runs"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    found = found.mapInArrow(_matcher(slim.sparkSession.sparkContext.broadcast(pickle.dumps(index))), found.schema)
    out = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>"
    return found.drop("t").mapInArrow(_finish, out)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs in which no window of an item occurs, with all columns. The text alone decides, whatever the id:
    a row is judged where it is, or, for a large benchmark, found again by its text's digest."""
    index = _small_index(docs.select(utf8(F.col(text_col)).alias("t")), _named_items(items, item_col, item_text), window, block_bytes)
    if index is None:
        key = own_name(docs, "digest")
        keyed = docs.withColumn(key, F.unhex(F.md5(utf8(F.col(text_col)))))
        found = find_items(keyed, items, window, key, text_col, item_col, item_text, block_bytes)
        hit = materialise(found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
        return without_ids(keyed, hit, key).drop(key)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))

    def start():
        held, hasher = pickle.loads(shared.value), _Hasher()

        def clean(rows: list[tuple]) -> list[bool]:
            keep = np.ones(len(rows), dtype=bool)
            for first, group in _grouped([t or b"" for (t,) in rows]):
                words = tokenise(group, hasher)
                keep[first + np.searchsorted(words.firsts, search(words, held)[0], side="right") - 1] = False
            return keep.tolist()

        return clean

    return filter_rows(docs, [text_col], start)
